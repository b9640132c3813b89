"""Refreshing all tables beside the old ones, so that a load never disturbs a report and may fail half-way.

A version is a folder with a full set of tables; a small file names the one that counts. It is replaced in one step
when the new version is whole. Readers look it up once and stay with what they found.
"""

from __future__ import annotations

from datetime import UTC, datetime
from uuid import uuid4

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from bazaarlens.session import remove_dir

_POINTER, _VERSIONS = "current", "versions"


def _path(spark: SparkSession, name: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path: JavaObject) -> JavaObject:
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, warehouse_dir: str) -> str:
    """Folder of the version that counts; the warehouse folder itself where none was ever made."""
    where = _path(spark, f"{warehouse_dir}/{_POINTER}")
    files = _files(spark, where)
    if not files.exists(where):
        return warehouse_dir
    stream = files.open(where)
    try:
        return f"{warehouse_dir}/{_VERSIONS}/{stream.readUTF()}"
    finally:
        stream.close()


def new_version(warehouse_dir: str) -> str:
    """Folder for a version to be loaded. Names sort by time."""
    return f"{warehouse_dir}/{_VERSIONS}/{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"


def switch(spark: SparkSession, warehouse_dir: str, version: str) -> None:
    """Make a whole version the one that counts: the file is written under another name and renamed over the old one."""
    where, new = _path(spark, f"{warehouse_dir}/{_POINTER}"), _path(spark, f"{warehouse_dir}/.{_POINTER}-{uuid4().hex}")
    stream = _files(spark, new).create(new, False)
    try:
        stream.writeUTF(version.rsplit("/", 1)[1])
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        _files(spark, where).getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(_files(spark, new).makeQualified(new), _files(spark, where).makeQualified(where), options)


def drop_old(spark: SparkSession, warehouse_dir: str, keep: int = 2) -> list[str]:
    """Delete versions older than the current one but for the ``keep - 1`` before it, and return their names.

    Newer folders stay: a load may be writing one. Keep as many as the longest report may still be reading.
    """
    where = _path(spark, f"{warehouse_dir}/{_VERSIONS}")
    files = _files(spark, where)
    now = current(spark, warehouse_dir).rsplit("/", 1)[1]
    names = sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []
    old = [name for name in names if name < now]
    gone = old[: max(0, len(old) - (keep - 1))] if now in names else []
    for name in gone:
        remove_dir(spark, f"{warehouse_dir}/{_VERSIONS}/{name}")
    return gone
