"""Naming the segment a row belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from bazaarlens.functions.rules import first_match


def segment_by_rules(
    df: DataFrame, name: str, rules: Sequence[tuple[str, Column]], default: str
) -> DataFrame:
    """Add a column with the label of the first rule that holds for the row."""
    return df.withColumn(name, first_match(rules, default))
