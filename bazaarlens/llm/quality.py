"""Ordinal quality model: cumulative-link regression of graded ratings on hashed text features.

One weight vector over hashed features is shared by all grades; ordered thresholds cut the score:
P(grade <= k) = 1 / (1 + exp(score - threshold_k)). From it come the expected grade, and the probability of
reaching the grade wanted, by which documents are selected.

Features of a text, in 2^18 hashed buckets: each word that occurs (1), and, as three times the square root of
their share of all runs, each kind of punctuation, words in capitals, and words equal to the one before. The
model is fitted in numpy on a bounded sample of labelled rows (``SAMPLE`` rows with the smallest hash of their
id, texts up to ``SAMPLE_BYTES``); scoring reads every row and whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, in_tasks, keyed, shared_folder, stored, without_rows
from bazaarlens.llm.words import LETTERS, as_bytes, byte_class, mixed, portions, runs, slices

SAMPLE = 10_000
SAMPLE_BYTES = 1 << 16
BITS = 18
# A bucket takes part if its link with some grade is this many standard errors from chance, in 10 rows at least.
LEAST_Z = 4.0
LEAST_ROWS = 10
STEPS, RATE, RIDGE = 300, 0.05, 5e-4

_RUNS = byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E), inside=2)
_RUNS[LETTERS > 0] = 1
_UPPER = byte_class((0x41, 0x5A)).astype(np.int64)
_ALPHA = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)).astype(np.int64)
_SHAPES = mixed(np.arange(1, 4, dtype=np.uint64)) >> np.uint64(64 - BITS)


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, bucket, value), by text; only the ``wanted`` buckets (a table of booleans) where given."""
    words, marks, total = [], [], np.zeros(len(texts), np.int64)
    before = (-1, 0)  # text and hash of the last word of the slice before

    def keep(rows: np.ndarray, kinds: np.ndarray, into: list) -> None:
        some = slice(None) if wanted is None else wanted[kinds]
        into.append((rows[some].astype(np.int64) << BITS) | kinds[some])

    for parts in slices(texts, _RUNS):
        raw, start, end, kind, text, found = runs(parts, _RUNS)
        upper, alpha = (np.concatenate(([0], np.cumsum(t[raw]))) for t in (_UPPER, _ALPHA))
        up = upper[end] - upper[start]
        word, mark = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        of, said = np.append(before[0], text[word]), np.append(np.uint64(before[1]), found[word])
        again = word[(of[1:] == of[:-1]) & (said[1:] == said[:-1])]
        before = (of[-1], said[-1])
        capitals = np.flatnonzero((up >= 2) & (2 * up >= alpha[end] - alpha[start]))
        total += np.bincount(text, minlength=len(texts))
        keep(text[word], (found[word] >> np.uint64(64 - BITS)).astype(np.int64), words)
        keep(text[mark], (mixed(found[mark] + np.uint64(1)) >> np.uint64(64 - BITS)).astype(np.int64), marks)
        keep(text[capitals], np.full(len(capitals), int(_SHAPES[0])), marks)
        keep(text[again], np.full(len(again), int(_SHAPES[1])), marks)
    none = np.zeros(0, np.int64)
    present = np.unique(np.concatenate([none, *words]))
    shared, count = np.unique(np.concatenate([none, *marks]), return_counts=True)
    value = np.concatenate((np.ones(len(present)), 3 * np.sqrt(count / np.maximum(total[shared >> BITS], 1))))
    key = np.concatenate((present, shared))
    order = np.argsort(key, kind="stable")
    return (key >> BITS)[order], (key & ((1 << BITS) - 1))[order], value[order]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one fewer than there are grades

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        row, bucket, value = features(texts, self.weights != 0)
        score = np.bincount(row, value * self.weights[bucket], minlength=len(texts))
        return _sigmoid(score[:, None] - self.thresholds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _telling(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> np.ndarray:
    """Buckets whose value goes with passing some grade more than chance would have it."""
    size, n = 1 << BITS, len(grade)
    total, squares = (np.bincount(bucket, v, minlength=size) for v in (value, value**2))
    found = np.zeros(size, bool)
    for cut in range(1, grades):
        passed = (grade >= cut).astype(float)
        share = passed.mean()
        excess = np.bincount(bucket, value * (passed[row] - share), minlength=size)
        spread = np.sqrt(np.maximum(share * (1 - share) * (squares - total**2 / n), 1e-12))
        found |= np.abs(excess) >= LEAST_Z * spread
    return found & (np.bincount(bucket, minlength=size) >= min(LEAST_ROWS, max(2, n // 20)))


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> OrdinalModel:
    """Penalised maximum likelihood by Adam; the same rows in the same order give the same model."""
    keep = _telling(row, bucket, value, grade, grades)[bucket]
    row, value = row[keep], value[keep]
    used, bucket = np.unique(bucket[keep], return_inverse=True)
    n = len(grade)
    below = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(0.5 / n, 1 - 0.5 / n)
    at = np.concatenate((np.zeros(len(used)), np.maximum.accumulate(np.log(below / (1 - below)))))
    first, second = np.zeros_like(at), np.zeros_like(at)
    lower, upper = np.maximum(grade - 1, 0), np.minimum(grade, grades - 2)
    for step in range(1, STEPS + 1):
        weights, cut = at[: len(used)], at[len(used) :]
        cumulative = _sigmoid(cut - np.bincount(row, value * weights[bucket], minlength=n)[:, None])
        slope = cumulative * (1 - cumulative)
        every = np.arange(n)
        high = np.where(grade == grades - 1, 1.0, cumulative[every, upper])
        low = np.where(grade == 0, 0.0, cumulative[every, lower])
        chance = np.maximum(high - low, 1e-9)
        up = np.where(grade == grades - 1, 0.0, slope[every, upper]) / chance
        down = np.where(grade == 0, 0.0, slope[every, lower]) / chance
        by_cut = np.bincount(upper, up, minlength=grades - 1) - np.bincount(lower, down, minlength=grades - 1)
        by_weight = np.bincount(bucket, value * (down - up)[row], minlength=len(used)) / n - RIDGE * weights
        gradient = np.concatenate((by_weight, by_cut / n))
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        at = at + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        at[len(used) :] = np.maximum.accumulate(at[len(used) :])
    weights = np.zeros(1 << BITS)
    weights[used] = at[: len(used)]
    return OrdinalModel(weights, at[len(used) :])


def train(docs: DataFrame, graded: DataFrame, grades: int, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel | None:
    """Fit on the labelled sample of ``graded`` (doc_id, grade); None if it holds fewer than two grades.

    Labels without an id or a grade are left out, and of several labels of a document the lowest counts. Copies of
    a document are one row.
    """
    labels = graded.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    drawn = labels.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(SAMPLE)
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), filled(F.col(text)).alias("text"))
        .filter(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(drawn), "doc_id")  # SAMPLE rows of two numbers at most
        .groupBy("doc_id", "grade")
        .agg(F.min("text").alias("text"))
    )

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            row, bucket, value = features(as_bytes(batch.column("text")))
            ends = np.searchsorted(row, np.arange(1, batch.num_rows))
            lists = [[x.tobytes() for x in np.split(v, ends)] for v in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("grade"), *(pa.array(x, pa.binary()) for x in lists)],
                names=["id", "grade", "buckets", "value"],
            )

    got = in_tasks(rows, per_batch, "id string, grade int, buckets binary, value binary").toArrow().sort_by("id")
    grade = got.column("grade").to_numpy().astype(np.int64).clip(0, grades - 1)
    if len(np.unique(grade)) < 2:
        return None
    buckets, value = (np.frombuffer(b"".join(got.column(c).to_pylist()), t) for c, t in (("buckets", np.int32), ("value", np.float32)))
    size = np.array([len(b) // 4 for b in got.column("buckets").to_pylist()])
    return fit(np.repeat(np.arange(len(size), dtype=np.int32), size), buckets, value, grade, grades)


def quality_grades(
    docs: DataFrame, model: OrdinalModel | None, wanted: int = 2, least: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its expected grade, the chance of grade ``wanted`` or better, and whether it stays.

    A text without any character but white space has grade 0 and does not stay; null counts as empty. Without a
    model (labels of fewer than two grades) every row stays and has no grade. Other columns are not read.
    Columns: file, row, doc_id, expected_grade, p_wanted, kept.
    """
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    if model is None:
        unknown = F.lit(None).cast("double")
        return rows.select("file", "row", "doc_id", unknown.alias("expected_grade"), unknown.alias("p_wanted"), F.lit(True).alias("kept"))
    fitted = rows.sparkSession.sparkContext.broadcast(model)  # 2^18 weights

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = as_bytes(batch.column("text"))
            above = fitted.value.above(texts)
            above[np.array([not t.strip() for t in texts], bool)] = 0.0
            chance = above[:, wanted - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(above.sum(axis=1)), pa.array(chance), pa.array(chance >= least)],
                names=["file", "row", "doc_id", "expected_grade", "p_wanted", "kept"],
            )

    return in_tasks(rows, per_batch, f"file long, row long, doc_id {kind}, expected_grade double, p_wanted double, kept boolean")


def rating(quality: Column, toxic: Column) -> Column:
    """Grades of the two labels: 0 poor, 1 well written but toxic, 2 good; null without the first label."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when(quality == 1, 2)


def graded(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", rating(F.col("quality"), F.col("toxic")).alias("grade"))


def drop_poor(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the model rejects.

    Null, empty and white texts are rejected, copies and repeated rows alike. With labels of fewer than two grades, or
    none, every row stays. An empty table stays empty; all columns pass as they are, whatever their names.
    """
    model = train(docs, graded(labels), 3)
    rejected = quality_grades(docs, model).filter(~F.col("kept")).select("file", "row")
    return without_rows(docs, stored(rejected, shared_folder(spark), "rejected"))
