"""Metrics with a grand-total row, side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_metric(
    totals: DataFrame, key: str, add_up: Sequence[str], metrics: Mapping[str, Column]
) -> DataFrame:
    """Metrics per key and over all keys.

    ``totals`` holds one row per key with columns that add up. Rolling those up, instead of the rows behind
    them, keeps the row doubling of a rollup off the large input. ``is_total`` marks the total row, so that
    it is never taken for a missing key.
    """
    rolled = totals.rollup(key).agg(
        F.grouping(key).alias("is_total"), *(F.sum(name).alias(name) for name in add_up)
    )
    return rolled.select(key, "is_total", *(value.alias(name) for name, value in metrics.items()))


def scorecard(
    first: DataFrame, others: Sequence[DataFrame], key: str, keep: Sequence[str], total_label: str
) -> DataFrame:
    """Join rolled-up metrics for the chosen keys and the total row, which comes last."""
    wanted = F.col(key).isin(*keep) | (F.col("is_total") == 1)
    card = first.filter(wanted)
    for number, other in enumerate(others):
        side = other.filter(wanted).select(
            F.col(key).alias(f"_key{number}"),
            F.col("is_total").alias(f"_total{number}"),
            *(name for name in other.columns if name not in (key, "is_total")),
        )
        same = F.col(key).eqNullSafe(F.col(f"_key{number}")) & (F.col("is_total") == F.col(f"_total{number}"))
        card = card.join(side, same, "left").drop(f"_key{number}", f"_total{number}")
    return card.withColumn(key, F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(key)))
