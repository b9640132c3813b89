"""Row identity, stored intermediate tables and dropping rows; used by every operator of this package."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.session import remove_dir, shared_dir

_FOLDERS: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor reaches, below ``spark.checkpoint.dir``."""
    folder = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_folders(spark: SparkSession) -> None:
    """Delete the tables this session has stored; call it when no result is read any more."""
    for folder in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        remove_dir(spark, folder)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written as a table and read again: lineage ends here, and a lost executor costs no more."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(df: DataFrame) -> list[Column]:
    """Two longs that name a row of ``df`` whenever it is read: its file and its place there.

    ``df`` is a stored table, possibly filtered or projected, or rows held in memory (no files: the running
    number). How a scan is cut into tasks changes with the executors at hand, so for files it takes no part.
    """
    try:
        meta = df.metadataColumn("_metadata")
        key = [F.xxhash64(meta.getField("file_path")), meta.getField("row_index")]
        df.select(*key).schema  # noqa: B018  (analysed here)
        return key
    except AnalysisException:
        return [F.lit(0).cast("long"), F.monotonically_increasing_id()]


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """``file``, ``row`` and the given columns, none of the others."""
    file, row = row_key(df)
    return df.select(file.alias("file"), row.alias("row"), *columns)


# Rows of a list up to which Spark may broadcast it, about 50 MB. Row keys compress so well in files that file
# sizes alone would let far longer lists pass.
BROADCAST_ROWS = 500_000


def without_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """``df`` without the rows that ``dropped`` names by ``file`` and ``row``.

    ``dropped`` is a stored table, so its size is known: a short list is broadcast by Spark's own rule and
    the texts are not shuffled, a long one is joined by the row key, which has no repeated value.
    """
    names = fresh(df, "_file", "_row")
    key = row_key(df)
    marked = df.withColumns(dict(zip(names, key, strict=True)))
    gone = dropped.select(*(F.col(c).alias(n) for c, n in zip(("file", "row"), names, strict=True)))
    if dropped.count() > BROADCAST_ROWS:
        gone = gone.hint("merge")
    return marked.join(gone, names, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def only_rows(df: DataFrame, wanted: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` that ``wanted`` (one row per key) names, with ``wanted``'s ``extra`` columns."""
    names = fresh(df, "_file", "_row")
    marked = df.withColumns(dict(zip(names, row_key(df), strict=True)))
    key = [F.col(c).alias(n) for c, n in zip(("file", "row"), names, strict=True)]
    listed = wanted.select(*key, *extra)
    return marked.join(listed, names).select(*(F.col(f"`{c}`") for c in df.columns), *extra)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out by the columns to as many tasks as shuffles have, however little they are now.

    For rows that the next step multiplies: adaptive execution would judge by their size before that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def in_tasks(df: DataFrame, per_task: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the session found it, whatever their folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return df.mapInArrow(per_task, schema)


def filled(text: Column) -> Column:
    """A text with null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))
