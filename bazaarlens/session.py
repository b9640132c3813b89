"""Session settings for a run of our own (the jobs work with any session they are given)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


# Shuffled data one task should get: what it sorts or hashes then fits in memory.
_PARTITION_MB = 128


def build_session(
    app_name: str = "bazaarlens", master: str | None = None, shuffle_gb: int | None = None, **conf: str
) -> SparkSession:
    """Session with adaptive execution on; on a cluster leave ``master`` to spark-submit.

    ``shuffle_gb`` is the size of the largest shuffle expected. It sets how many partitions a shuffle starts
    with; adaptive execution merges them by size where less was written, and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_gb:
        partitions = max(200, shuffle_gb * 1024 // _PARTITION_MB)
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", partitions)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Only a session on one machine that names none gets one of its own, which goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN_DIRS:
        _OWN_DIRS[application] = tempfile.mkdtemp(prefix="bazaarlens-")
        atexit.register(shutil.rmtree, _OWN_DIRS[application], ignore_errors=True)
    return _OWN_DIRS[application]


# Jobs run side by side: enough that one's last tasks and planning leave no cores idle.
_AT_ONCE = 4


def at_once(spark: SparkSession, calls: Iterable[Callable[[], None]]) -> None:
    """Run jobs that need nothing of each other side by side. All end before the first error, in the order given, is raised."""
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
    for job in started:
        job.result()


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what a job shuffled leaves the disks when the job ends. Else it stays until the driver happens to collect
    its garbage, which a driver with little to do may not for half an hour. The session's setting is put back after."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
