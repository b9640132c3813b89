"""Tables stored by bucket of the order id inside their month directories, so that joins by order move no rows.

Spark reads bucket n of every such table in one task, whichever months are opened. A table whose order ids do not spread
evenly is left in the plain layout: one hot order would be one task's work in every job, and a join without a
shuffle cannot be split at run time.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bazaarlens.sources.notes import read_note, write_note

KEY = "order_id"
# A bucket may have this many times the rows of the mean one, and small tables up to SMALL rows in one.
UNEVEN, SMALL = 4, 1_000_000


def spreads_evenly(df: DataFrame, buckets: int, uneven: float = UNEVEN, small: int = SMALL) -> bool:
    """Whether no bucket would hold far more rows than the others. Counted by the hash that the buckets use."""
    sizes = df.groupBy(F.pmod(F.hash(KEY), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return largest <= max(small, uneven * rows / buckets)


def write_buckets(df: DataFrame, path: str, partition: str, buckets: int) -> None:
    """Replace the files at ``path``. A task gets one bucket, by the bucket's own hash, which is one file per month."""
    name = f"bazaarlens_write_{uuid4().hex}"
    dealt = df.repartitionById(buckets, F.pmod(F.hash(KEY), F.lit(buckets)))
    writer = dealt.write.mode("overwrite").partitionBy(partition)
    writer.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the session's name for it only; the files stay


def note_buckets(spark: SparkSession, warehouse_dir: str, table: str, buckets: int) -> None:
    """Write down how a table is stored; 0 buckets means the plain layout."""
    write_note(spark, warehouse_dir, f"buckets_of_{table}", str(buckets))


def buckets_of(spark: SparkSession, warehouse_dir: str, table: str) -> int:
    """Buckets a table is stored in; 0 for the plain layout and for tables without a note."""
    return int(read_note(spark, warehouse_dir, f"buckets_of_{table}") or 0)


def open_buckets(spark: SparkSession, path: str, partition: str, buckets: int) -> DataFrame:
    """The files as a table whose buckets Spark knows. The name is the session's own and points at the files."""
    name = f"bazaarlens_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    schema = spark.read.parquet(path).schema
    columns = StructType([f for f in schema if f.name != partition] + [schema[partition]]).toDDL()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({partition}) "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
