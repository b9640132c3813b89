"""A load that survives bad rows: they are put aside with their file and the reason, up to a limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.schemas import COLUMN_TYPES, OTHER_TYPES
from bazaarlens.sources.raw_csv import MULTI_LINE_TABLES, RAW_FILES

_RECORD, _FILE = "_corrupt_record", "_file"


class TooManyBadRows(ValueError):
    """A table has more bad rows than the load may put aside."""


def read_text(spark: SparkSession, raw_dir: str, table: str) -> DataFrame:
    """One raw table as text columns, with the file of each row and, for a line that has another number of fields
    than the header, the line itself."""
    path = f"{raw_dir}/{RAW_FILES[table]}"
    options = {"header": True, "escape": '"', "multiLine": table in MULTI_LINE_TABLES}
    names = spark.read.options(**options).csv(path).columns
    missing = [name for name in COLUMN_TYPES[table] if name not in names]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)} in {path}")
    schema = ", ".join(f"`{name}` string" for name in [*names, _RECORD])
    text = (
        spark.read.options(**options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("columnPruning", False)
        .schema(schema)
        .csv(path)
    )
    return text.withColumn(_FILE, F.col("_metadata.file_path"))


def _types(text: DataFrame, table: str) -> dict[str, str]:
    kinds = OTHER_TYPES | COLUMN_TYPES[table]
    return {name: kinds.get(name, "string") for name in text.columns if name not in (_RECORD, _FILE)}


def reason(text: DataFrame, table: str) -> Column:
    """What is wrong with a row: the first column whose text does not fit its type, or its fields; NULL for a good one."""
    typed = [(name, kind) for name, kind in _types(text, table).items() if kind != "string"]
    misfit = reduce(
        lambda found, c: F.when(
            F.col(c[0]).isNotNull() & F.col(c[0]).try_cast(c[1]).isNull(),
            F.concat(F.lit(f"{c[0]} is no {c[1]}: "), F.col(c[0])),
        ).otherwise(found),
        reversed(typed),
        F.lit(None).cast("string"),
    )
    return F.when(F.col(_RECORD).isNotNull(), F.lit("not as many fields as the header")).otherwise(misfit)


def good_rows(text: DataFrame, table: str) -> DataFrame:
    """Rows without fault, typed."""
    kept = text.filter(reason(text, table).isNull())
    return kept.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in _types(text, table).items()))


def bad_rows(text: DataFrame, table: str) -> DataFrame:
    """Columns table, file, reason, record: the others, with the line or, where it could be read, its fields as JSON."""
    fields = F.to_json(F.struct(*(F.col(f"`{name}`") for name in _types(text, table))))
    found = text.withColumn("reason", reason(text, table)).filter(F.col("reason").isNotNull())
    return found.select(F.lit(table).alias("table"), F.col(_FILE).alias("file"), "reason", F.coalesce(_RECORD, fields).alias("record"))


def put_aside(text: DataFrame, warehouse_dir: str, table: str, most: int) -> int:
    """Store a table's bad rows under ``quarantine`` and return their number; more than ``most`` fail the load.

    They are stored in either case, and before the table itself is touched.
    """
    path = f"{warehouse_dir}/quarantine/{table}"
    bad_rows(text, table).write.mode("overwrite").parquet(path)
    stored = text.sparkSession.read.parquet(path)
    count = stored.count()
    if count > most:
        shown = "; ".join(r["reason"] for r in stored.orderBy("file", "reason", "record").limit(3).collect())
        raise TooManyBadRows(f"{table}: {count} bad rows, {most} allowed; see {path}. First: {shown}")
    return count
