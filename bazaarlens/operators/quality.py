"""Counting rows that should not exist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.metrics import total_where


def dq_count(
    df: DataFrame, checks: Mapping[str, Column], total: str, weight: Column | None = None
) -> DataFrame:
    """One row: rows in all and rows failing each check. ``weight`` is how many rows a row stands for."""
    if weight is None:
        counts = [total_where(failed).alias(name) for name, failed in checks.items()]
        return df.agg(F.count(F.lit(1)).alias(total), *counts)
    counts = [
        F.sum(F.when(failed, weight).otherwise(F.lit(0))).alias(name) for name, failed in checks.items()
    ]
    return df.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias(total), *counts)
