"""Short notes beside the stored tables: how one is laid out, and from what a derived column was made."""

from __future__ import annotations

from pyspark.sql import SparkSession

_NOTES = "notes"


def write_note(spark: SparkSession, warehouse_dir: str, name: str, value: str) -> None:
    row = spark.createDataFrame([(value,)], "value string").coalesce(1)
    row.write.mode("overwrite").parquet(f"{warehouse_dir}/{_NOTES}/{name}")


def read_note(spark: SparkSession, warehouse_dir: str, name: str) -> str | None:
    """The note's value, or None where there is none."""
    path = f"{warehouse_dir}/{_NOTES}/{name}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("value string").parquet(path).first()[0]
