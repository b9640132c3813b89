"""Comparing what was charged with what was paid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.metrics import pct, total_where


def reconcile_totals(
    charged: DataFrame, paid: DataFrame, key: str, due: Column, received: Column, tolerance: int
) -> DataFrame:
    """One row: keys on both sides, how many differ by less than the tolerance, and the totals of every other
    column.

    Both sides must already have one row per key; joining them earlier would multiply the amounts.
    """
    pairs = charged.join(paid, key)
    agree = total_where(F.abs(received - due) < F.lit(tolerance))
    total = F.count(F.lit(1))
    amounts = [name for name in pairs.columns if name != key]
    return pairs.agg(
        total.alias("total_orders"),
        agree.alias("matched_orders"),
        pct(agree, total).alias("matched_pct"),
        *(F.sum(name).alias(name) for name in amounts),
    )
