"""Shares, ranks and leading rows of aggregated results.

``many_rows=False`` is for results with one row per label (quarter, payment type, category): an unpartitioned
window over them is a handful of rows. ``many_rows=True`` is for results that grow with the data, such as one
row per seller, and never gathers the rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bazaarlens.functions.metrics import ratio


def _over_all(total: Column) -> Column:
    return total.over(W.partitionBy())


def _exact(value: Column) -> Column:
    return value.cast("decimal(28,2)")


def share_of_total(df: DataFrame, value: str, name: str, many_rows: bool = False) -> DataFrame:
    """Add the value's percentage of the column total."""
    amount = _exact(F.col(value))
    if many_rows:
        total = df.agg(_exact(F.sum(value)).alias("_total")).scalar()
    else:
        total = _exact(_over_all(F.sum(value)))
    return df.withColumn(name, ratio(amount, total, 100))


def cumulative_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the running percentage of the total, largest first; equal values move together."""
    running = W.orderBy(F.col(value).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    total = _over_all(F.sum(value))
    return df.withColumn(name, ratio(_exact(F.sum(value).over(running)), _exact(total), 100))


def dense_rank_desc(df: DataFrame, value: str, name: str, many_rows: bool = False) -> DataFrame:
    """Add the dense rank of a value, largest first.

    With ``many_rows`` only the distinct values are ranked and joined back. For a count of items that is a
    short list: n different counts need at least n*(n-1)/2 items, so 10^12 items give under 1.5 million.
    ``df`` is read twice; pass a stored one if it is costly.
    """
    rank = F.dense_rank().over(W.orderBy(F.col(value).desc())).cast("bigint")
    if not many_rows:
        return df.withColumn(name, rank)
    ranks = df.select(F.col(value).alias("_value")).distinct()
    ranks = ranks.withColumn(name, F.dense_rank().over(W.orderBy(F.col("_value").desc())).cast("bigint"))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort a result with one row per label.

    The rows are finished first, by as many tasks as there are, and then meet in one partition: nothing before
    that runs in a single task, and no sample is taken for a range shuffle.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Leading rows of a total order; each task keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)
