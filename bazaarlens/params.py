"""Periods, thresholds and labels. The defaults are the published study's own values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal


@dataclass(frozen=True)
class Period:
    """A labelled half-open time range ``[start, end)``."""

    label: str
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Params:
    # The two compared quarters.
    earlier: Period = Period("2018-Q1", datetime(2018, 1, 1), datetime(2018, 4, 1))
    later: Period = Period("2018-Q2", datetime(2018, 4, 1), datetime(2018, 7, 1))

    # Seller rules.
    min_items: int = 20
    exit_items: int = 5
    breach_limit: Decimal = Decimal("0.10")
    harm_items: int = 3

    # Freight, payment and category rules.
    min_corridor_items: int = 20
    match_tolerance: Decimal = Decimal("0.05")
    slow_approval_minutes: int = 1440
    min_category_rows: int = 100
    follow_up_before: datetime = datetime(2018, 3, 1)
    top_n: int = 10
    scorecard_categories: tuple[str, ...] = field(
        default=(
            "electronics",
            "office_furniture",
            "computers",
            "home_appliances",
            "fashion_bags_accessories",
        )
    )

    @property
    def periods(self) -> tuple[Period, Period]:
        return (self.earlier, self.later)

    @property
    def whole(self) -> Period:
        """Both quarters as one range."""
        return Period("whole", self.earlier.start, self.later.end)
