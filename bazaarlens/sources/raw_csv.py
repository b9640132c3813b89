"""Raw CSV files: which file holds which table, and reading them with declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.schemas import COLUMN_TYPES, OTHER_TYPES

# End of each file's name, whatever its prefix, and the table it holds.
RAW_FILES: dict[str, str] = {
    "customers": "*customers_dataset.csv",
    "orders": "*orders_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "order_payments": "*order_payments_dataset.csv",
    "order_reviews": "*order_reviews_dataset.csv",
    "products": "*products_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "geolocation": "*geolocation_dataset.csv",
    "category_translation": "*category_name_translation.csv",
}

# Free text may hold line breaks. Such a file cannot be split between tasks, so only these are read that way.
MULTI_LINE_TABLES = frozenset({"order_reviews"})


def raw_bytes(spark: SparkSession, raw_dir: str, table: str) -> int:
    """Size of a table's raw files as they are stored."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{raw_dir}/{RAW_FILES[table]}")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(files.getContentSummary(found.getPath()).getLength() for found in files.globStatus(pattern) or [])


def read_raw(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """One raw table, columns found by header name and cast to their declared types.

    A value that does not fit its type raises an error when it is read; an empty field is NULL.
    """
    text = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("multiLine", table in MULTI_LINE_TABLES)
        .csv(f"{raw_dir}/{RAW_FILES[table]}")
    )
    if table in MULTI_LINE_TABLES:
        text = text.hint("rebalance")
    types = COLUMN_TYPES[table]
    missing = [name for name in types if name not in text.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)} in {raw_dir}/{RAW_FILES[table]}")
    kinds = OTHER_TYPES | types
    return text.select(*(F.col(name).cast(kinds.get(name, "string")) for name in text.columns))
