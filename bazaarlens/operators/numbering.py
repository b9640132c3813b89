"""Whole numbers for the values of a column, in their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_ROW_BITS = 33  # of monotonically_increasing_id: the place within the partition


def dense_numbers(df: DataFrame, column: str, number: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each different value of the column, NULL left out, with its place (from 0) in their order.

    A prefix scan: the values are dealt by range and sorted in the tasks, numbered there, and every partition's numbers
    raised by the sizes of those before it. The window that adds up these sizes runs over one row per
    partition. ``keep`` stores the sorted values, so that their places are read, and not worked out anew.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = values.repartitionByRange(F.col(column)).sortWithinPartitions(column)
    placed = keep(placed.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0).cast("long")).alias("_before"))
    within = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", part).join(starts, "_part").select(column, (F.col("_before") + within).alias(number))
