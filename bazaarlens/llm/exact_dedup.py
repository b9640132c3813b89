"""Exact duplicates by merging sorted digest runs up a tree and sending the answers back down.

Every input partition becomes a run: its digests in order, one row each, with the smallest identifier and the
number of rows. Runs are merged ``FAN_IN`` at a time in rounds; what a round gets of one digest is at most
``FAN_IN`` rows, however many copies there are. Each merge is a sort aggregate: the runs are sorted, and rows
of one digest meet side by side. Rows count as equal only if SHA-256, length and a second, independent 64-bit
hash of the text agree, at every level. The answers go down the same tree: a merged row answers the at most
``FAN_IN`` rows it came from, and a run's row the copies inside one input partition. So no step gathers the
copies of a text, and only digests are moved, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, keyed, shared_folder, stored, without_rows

FAN_IN = 16
WHITE = r"[\x20\x09-\x0D]+"
_DIGEST = ["digest", "n_bytes", "check"]


def _digest_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    one_space = F.regexp_replace(filled(F.col(text)), WHITE, " ")
    return (
        keyed(docs, F.col(doc_id).alias("id"), one_space.alias("text"))
        .select(
            "file",
            "row",
            "id",
            F.spark_partition_id().alias("run"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.xxhash64("text").alias("check"),
        )
        .sortWithinPartitions(*_DIGEST, "id")
    )


def _merged(level: DataFrame, run: Column) -> DataFrame:
    return level.groupBy(run.alias("run"), *_DIGEST).agg(
        F.min("first").alias("first"), F.sum("copies").alias("copies")
    )


def exact_dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Texts are equal when identical after each run of ASCII white space has become one space. Null text counts
    as empty, so null, empty and no text at all are one group. Of a group the smallest id stays; a null id is
    above all others; of rows that share the smallest id exactly one stays. ``keep_id`` is null only if all
    ids of the group are. An empty table gives an empty result; other columns of ``docs`` are not read.
    Columns: file, row (the row's key), doc_id, keep_id, group_size, kept, text_sha256.
    """
    folder = shared_folder(spark)
    rows = stored(_digest_rows(docs, doc_id, text), folder, "rows")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "file", "row")
    runs = rows.withColumns({"first": first, "copies": F.lit(1).cast("long")})
    levels = [stored(_merged(runs, F.col("run")), folder, "level0")]
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        level = _merged(levels[-1], F.floor(F.col("run") / FAN_IN).cast("int"))
        levels.append(stored(level, folder, f"level{len(levels)}"))
        left = -(-left // FAN_IN)
    answers = levels[-1].filter(F.col("copies") > 1).select("run", *_DIGEST, "first", "copies")
    for level in reversed(levels[:-1]):
        below = level.select(F.col("run").alias("child"), *_DIGEST).withColumn(
            "run", F.floor(F.col("child") / FAN_IN).cast("int")
        )
        answers = below.join(answers, ["run", *_DIGEST]).select(
            F.col("child").alias("run"), *_DIGEST, "first", "copies"
        )
    kept = (F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row"))
    return rows.join(answers, ["run", *_DIGEST], "left").select(
        "file",
        "row",
        F.col("id").alias("doc_id"),
        F.when(F.col("copies").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(kept, F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    Null, empty and white-space-only texts follow ``exact_dedup``: null counts as empty. Of rows with the same text and id,
    repeated ones included, one stays. An empty table stays empty; all columns pass as they are, whatever their names.
    """
    dropped = exact_dedup(spark, docs).filter(~F.col("kept")).select("file", "row")
    return without_rows(docs, stored(dropped, shared_folder(spark), "dropped"))
