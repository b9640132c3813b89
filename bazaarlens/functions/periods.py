"""Half-open calendar ranges: labels, filters and month keys."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.params import Period
from bazaarlens.schemas import FACTS_PARTITION, ORDERS_PARTITION

# Coarse copies of the purchase time that tables may carry: on orders, and on tables with several rows per
# order. Each is the timestamp rounded down. A predicate on one prunes directories or row groups; Catalyst
# cannot infer it from the exact one.
COARSE_ORDER_COLUMNS = {ORDERS_PARTITION: "MONTH", "purchase_day": "DAY"}
COARSE_FACT_COLUMNS = {FACTS_PARTITION: "MONTH", "order_day": "DAY"}


def moment(value: datetime) -> Column:
    """Zone-less timestamp literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def within(ts: Column, period: Period) -> Column:
    """``start <= ts < end``, on the bare column so that it can be pushed to the scan."""
    return (ts >= moment(period.start)) & (ts < moment(period.end))


def period_bucket(ts: Column, periods: Sequence[Period]) -> Column:
    """Label of the period a time falls in; NULL outside all of them."""
    first, *rest = periods
    bucket = F.when(within(ts, first), F.lit(first.label))
    for period in rest:
        bucket = bucket.when(within(ts, period), F.lit(period.label))
    return bucket


def _reaches(coarse: str, unit: str, period: Period) -> Column:
    """Whether a rounded-down time can belong to one in the period."""
    floor = period.start.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "MONTH":
        floor = floor.replace(day=1)
    return (F.col(coarse) >= moment(floor)) & (F.col(coarse) < moment(period.end))


def purchased_within(orders: DataFrame, period: Period) -> Column:
    """Purchase-time range, repeated on the coarse column if the table has one."""
    condition = within(F.col("order_purchase_timestamp"), period)
    for name, unit in COARSE_ORDER_COLUMNS.items():
        if name in orders.columns:
            condition = condition & _reaches(name, unit, period)
    return condition


def dated_within(rows: DataFrame, at: str, month: str, period: Period) -> DataFrame:
    """Rows whose own date is in the period, of a table kept by that date's month."""
    return rows.filter(within(F.col(at), period) & _reaches(month, "MONTH", period)).drop(month)


def facts_around(facts: DataFrame, period: Period) -> DataFrame:
    """Items, payments or reviews without the months whose orders cannot fall in the period.

    Only a table that carries its orders' month has anything to leave out; which rows count is decided by
    the join with their order. Rows without a month (no known order, or one listed in several months) stay.
    """
    for name, unit in COARSE_FACT_COLUMNS.items():
        if name in facts.columns:
            facts = facts.filter(_reaches(name, unit, period) | F.col(name).isNull()).drop(name)
    return facts


def month_start(ts: Column) -> Column:
    """First day of the month, as a DATE: a fixed-width grouping key."""
    return F.trunc(F.to_date(ts), "month")


def month_label(month: Column) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(month, "yyyy-MM")
