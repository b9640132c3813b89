"""Repeat buying by how a customer started."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.metrics import count_where, pct
from bazaarlens.functions.periods import moment


def started_with(first: DataFrame, main: DataFrame, before: datetime | None = None, key: str = "order_id") -> DataFrame:
    """First orders with the main record of each; ``before`` keeps customers who had time to return."""
    if before is not None:
        first = first.filter(F.col("order_purchase_timestamp") < moment(before))
    return first.join(main, key)


def came_back():
    """Customers with a second order, whatever it holds."""
    return count_where(F.col("total_orders") > 1)


def cohort_repeat(started: DataFrame, label: str, name: str, min_rows: int | None = None) -> DataFrame:
    """Customers per starting label, and how many came back."""
    total = F.count(F.lit(1))
    cohorts = started.groupBy(F.col(label).alias(name)).agg(
        total.alias("total_customers"),
        came_back().alias("came_back"),
        pct(came_back(), total).alias("came_back_pct"),
    )
    return cohorts if min_rows is None else cohorts.filter(F.col("total_customers") >= min_rows)
