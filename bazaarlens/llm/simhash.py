"""SimHash fingerprints and their groups, found through deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 3 bits are cut into two halves: one half then differs in at most
one bit. So every half is indexed under its 32 variants with one bit as a wildcard, and two halves that
differ in at most that bit meet under the same signature. The index holds each half value once, not each
fingerprint, so a signature has at most two rows (the wildcard bit 0 or 1) whatever the data. The pairs of
half values found so are joined back to their fingerprints, whose other halves are then compared bit by bit.

Where one pair of half values belongs to more than ``BUCKET`` fingerprints, the same cut is made again
inside: the other half (16 + 16 bits, one differs in at most one bit) and then what is left (8 + 8). After
that at most 2 * 2 * 2 * 256 = 2,048 different fingerprints can share a bucket, so no bucket needs a cap and no
pair is lost. A large bucket does not give all its pairs as links but, per component of its own, one link from
each fingerprint to the smallest: the components of all links are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.components import components
from bazaarlens.llm.shared import in_tasks, keyed, shared_folder, spread, stored, without_rows
from bazaarlens.llm.words import as_bytes, portions

SHINGLE = 3
MAX_BITS = 3
SEED = 42
# Fingerprints of a bucket that are compared directly; the last cut never leaves more.
BUCKET = 2048
# Buckets up to this size give all their pairs as links.
_SMALL = 16
_BLOCK = 1 << 18


def _fingerprint(text: bytes, size: int, seed: int) -> int:
    """Bits set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    count = max(1, len(words) - size + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Columns file, row, doc_id, fp: the fingerprint of every text, as a signed long."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            found = [_fingerprint(t, size, seed) for t in as_bytes(batch.column("text"))]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "row", "doc_id")), fp], names=["file", "row", "doc_id", "fp"])

    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return in_tasks(rows, per_batch, f"file long, row long, doc_id {kind}, fp long")


def _half(fp: Column, which: Column) -> Column:
    """Half 1 is the upper, 0 the lower 32 bits."""
    return F.when(which == 1, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def _neighbour_values(halves: DataFrame) -> DataFrame:
    """Pairs of half values (a, b) that differ in one bit: equal in one of their 32 deletion variants."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    variants = spread(halves, "which", "value").select("which", "value", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")).select(
        "which",
        "bit",
        F.col("value").bitwiseAND(F.bitwise_not(bit)).alias("rest"),
        F.when(F.col("value").bitwiseAND(bit) != 0, 2).otherwise(1).alias("side"),
    )
    met = variants.groupBy("which", "bit", "rest").agg(F.bit_or("side").alias("sides")).filter("sides = 3")
    return met.select("which", F.col("rest").alias("a"), F.col("rest").bitwiseOR(bit).alias("b"))


def _members(prints: DataFrame, halves: DataFrame) -> DataFrame:
    """Columns which, bucket, side, fp: the fingerprints to compare, and whether the bucket has two sides."""
    pairs = _neighbour_values(halves).withColumn("bucket", F.xxhash64("which", "a", "b"))
    ends = pairs.select(
        "which", "bucket", F.explode(F.array(*(F.struct(F.col(x).alias("value"), F.lit(s).alias("side")) for x, s in (("a", 1), ("b", 2))))).alias("e")
    ).select("which", "bucket", "e.value", "e.side")
    same = halves.filter("n > 1").select("which", F.xxhash64("which", "value").alias("bucket"), "value", F.lit(0).alias("side"))
    split = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("which"))
    split = split.withColumn("value", _half(F.col("fp"), F.col("which")))
    return split.join(ends.union(same), ["which", "value"]).select("which", "bucket", "side", "fp")


def _cut_again(members: DataFrame, bits: int) -> DataFrame:
    """Buckets by one-wildcard variants of parts of ``bits`` bits of what the bucket has not yet fixed.

    ``offset`` is where the unfixed bits start and ``2 * bits`` how many there are; one of the two parts of
    ``bits`` bits differs in at most one.
    """
    part = F.col("offset") + F.col("part") * bits
    value = F.call_function("shiftrightunsigned", F.col("fp"), part).bitwiseAND(F.lit((1 << bits) - 1))
    rest = value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
    return (
        members.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
        .select(
            F.xxhash64("bucket", "part", "bit", rest).alias("bucket"),
            "side",
            "fp",
            (F.col("offset") + (1 - F.col("part")) * bits).alias("offset"),
        )
    )


def _apart(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets of at most ``most`` fingerprints, and the others."""
    large = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("bucket")
    return members.join(large, "bucket", "left_anti"), members.join(large, "bucket", "left_semi")


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a symmetric table of neighbours: each member that has a smaller one in its component, and that one."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(axis=1)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(near)))
    return child, label[child]


def _bucket_links(fp: np.ndarray, side: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside the buckets [start, end) of rows sorted by bucket."""
    found = []
    size = end - start
    number = np.repeat(np.arange(len(start)), size)
    for step in range(1, min(_SMALL, int(size.max(initial=1)))):
        a, b = np.arange(len(fp) - step), np.arange(step, len(fp))
        both = (number[a] == number[b]) & (size[number[a]] <= _SMALL) & ((side[a] == 0) | (side[a] != side[b]))
        a, b = a[both], b[both]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= most
        found.append((fp[a[near]], fp[b[near]]))
    for s, e in zip(start[size > _SMALL], end[size > _SMALL], strict=True):
        f, w = fp[s:e], side[s:e]
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= most
        near &= (w[:, None] == 0) | (w[:, None] != w[None, :])
        child, parent = _forest(near)
        found.append((f[child], f[parent]))
    return found


def _links(members: DataFrame, most: int) -> DataFrame:
    """Links (u, v) from verified pairs inside the buckets. Rows come sorted by bucket; one bucket is held at a time."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, t) for t in (np.int64, np.int32, np.uint64)]

        def links(bucket, side, fp):
            start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
            pairs = _bucket_links(fp, side, start, np.append(start[1:], len(bucket)), most)
            u, v = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.uint64)]) for i in (0, 1))
            # The same pair meets under many variants; once from a batch is enough.
            uv = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v)), axis=1), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "side", "fp")]
            new[2] = new[2].view(np.uint64)
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(kept[0]):
                whole = int(np.searchsorted(kept[0], kept[0][-1]))
                if whole:
                    yield links(*(x[:whole] for x in kept))
                    kept = [x[whole:] for x in kept]
        if len(kept[0]):
            yield links(*kept)

    ready = members.select("bucket", "side", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp", "side")
    return in_tasks(ready, per_task, "u long, v long").distinct()


def linked(prints: DataFrame, folder: str, most: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``prints.fp`` (distinct) within ``most`` bits.

    ``most`` may be up to 3: two parts then always leave one that differs in at most one bit.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    halves = prints.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("which"), "fp")
    halves = halves.select("which", _half(F.col("fp"), F.col("which")).alias("value"))
    halves = stored(halves.groupBy("which", "value").agg(F.count(F.lit(1)).alias("n")), folder, "halves")
    members = stored(_members(prints, halves), folder, "members")
    small, large = _apart(members, bucket)
    found = _links(small, most)
    large = stored(large.withColumn("offset", F.when(F.col("which") == 1, 0).otherwise(32)).drop("which"), folder, "large")
    if not large.isEmpty():
        small, larger = _apart(_cut_again(large, 16), bucket)
        larger = stored(larger, folder, "larger")
        found = found.union(_links(small, most)).union(_links(_cut_again(larger, 8), most))
    return found


def simhash_groups(
    spark: SparkSession,
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE,
    most: int = MAX_BITS,
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: its fingerprint and its group of linked fingerprints.

    Null, empty and all-space texts have fingerprint zero and are linked like any other; texts of fewer words
    than a shingle are hashed whole. Rows with equal fingerprints are one node, so copies cost nothing.
    ``component_id`` is the smallest doc_id of the group, null only if all its ids are null; ``kept`` is true for
    exactly one row per group, one with that id. An empty table gives an empty result; other columns of
    ``docs`` are not read. Columns: file, row, doc_id, fingerprint, component_id, kept.
    """
    folder = shared_folder(spark)
    rows = stored(fingerprints(docs, doc_id, text, size), folder, "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("first")
    nodes = stored(rows.groupBy("fp").agg(first), folder, "nodes")
    root = components(linked(nodes.select("fp"), folder, most, bucket), folder)
    rooted = nodes.join(root, nodes["fp"] == root["u"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    answer = rooted.join(heads, "root").select("fp", "head")
    return rows.join(answer, "fp").select(
        "file",
        "row",
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        ((F.col("head.file") == F.col("file")) & (F.col("head.row") == F.col("row"))).alias("kept"),
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    Texts without words, null ones included, have fingerprint zero and are grouped by it like any other. Of rows with
    the same text and id one stays. An empty table stays empty; all columns pass as they are, whatever their names.
    """
    dropped = simhash_groups(spark, docs).filter(~F.col("kept")).select("file", "row")
    return without_rows(docs, stored(dropped, shared_folder(spark), "dropped"))
