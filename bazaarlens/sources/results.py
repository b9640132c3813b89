"""Writing result sets as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Header, comma, NULL written as the word. ``single_file`` is for results of a few rows."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).option("nullValue", "NULL").csv(path)
