"""Joining a large table to one with unique keys when a few keys hold very many rows.

Adaptive execution splits an oversized join partition by itself, but only where the join reads both its
inputs straight from a shuffle and the next step does not rely on their partitioning. The join here covers
the other case: a lookup that is itself the result of a join on the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key from which it is split, and the size of a piece.
HOT_ROWS = 1_000_000
# A key is split only if it holds at least one in so many of all rows, so the list has at most so many keys.
_MOST_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with ``hot_rows`` rows or more and the number of pieces to cut each into.

    Keys are counted exactly, in one narrow scan whose rows are combined before the shuffle. A key that holds
    less than one in ``_MOST_KEYS`` of the rows is not listed: a task has room for that much.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_rows"))
    least = F.greatest(F.lit(hot_rows), F.coalesce(F.floor(df.agg(F.count(F.lit(1))).scalar() / _MOST_KEYS), F.lit(0)))
    return counts.filter(F.col("_rows") >= least).select(
        "_hot", F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_pieces")
    )


def salted_join(facts: DataFrame, lookup: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join on ``key``, where ``lookup`` has one row per key and ``facts`` may have any number.

    Equal rows are counted first and sent in lots of at most ``hot_rows``. Lots of a hot key are spread over
    its pieces by a hash of the row and the lot, the same on every attempt, and the lookup row is repeated once
    per piece. All other keys have one piece. Counts are exact, so both sides agree on the pieces.
    """
    hot = F.broadcast(hot_keys(facts, key, hot_rows))  # at most _MOST_KEYS keys
    names = facts.columns
    lots = (
        facts.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / hot_rows))))
        .withColumn("_n", F.least(F.lit(hot_rows).cast("bigint"), F.col("_n") - F.col("_lot") * hot_rows))
    )
    piece = F.when(F.col("_pieces") > 1, F.pmod(F.xxhash64(*names, "_lot"), F.col("_pieces")).cast("int"))
    spread = (
        lots.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_piece", F.coalesce(piece, F.lit(0)))
        .drop("_hot", "_pieces", "_lot")
    )
    last = F.coalesce(F.col("_pieces"), F.lit(1)) - 1
    repeated = (
        lookup.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        .drop("_hot", "_pieces")
    )
    joined = spread.join(repeated, [key, "_piece"]).drop("_piece")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))
    return joined.withColumn("_n", each).drop("_n")
