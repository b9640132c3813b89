"""Centroid clustering on integers, with equal-average equal-variance search for the nearest centroid.

Vectors become whole numbers, so sums and squared distances are exact and do not depend on how rows are dealt to
tasks. Every round the tasks look for each vector's nearest centroid and add up what they found; a few sums per
centroid leave a task. The search goes through the centroids in order of their mean, outwards from the vector's
own mean. With sums S, D components and A = D * (sum of squares) - S**2, a centroid at squared distance d obeys

    (S - S')**2 <= D * d                                      (means)
    (S - S')**2 + (sqrt(A) - sqrt(A'))**2 <= D * d            (means and deviations)

so a centroid that breaks one of them for the best distance so far is passed over, and one that breaks the first
ends the search on its side. All of this is in integers; roots are bounded from below. Only what is left has its
distance worked out. Numbers too large for 64-bit steps are handled as Python integers by the same code.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import in_tasks, keyed, shared_folder, stored
from bazaarlens.llm.vectors import by_length, vector_portions

DIMENSION, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
# Up to here all steps of the search fit 64 bits (for up to 64 components).
_PLAIN = 1 << 24
# Largest whole number a component may have.
LARGEST = 1 << 58
_LONG = 1 << 63

_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def _numbers(column: pa.Array) -> np.ndarray:
    """The stored vectors, one per line."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _plain(*of: np.ndarray) -> bool:
    return all(x.shape[-1] <= 64 and (not x.size or max(-int(x.min()), int(x.max())) <= _PLAIN) for x in of)


def _root(area: np.ndarray) -> np.ndarray:
    """Whole part of the square root, exact."""
    if area.dtype == object:
        return _isqrt(area)
    root = np.sqrt(area.astype(np.float64)).astype(np.int64)
    root -= root * root > area
    return root + ((root + 1) ** 2 <= area)


def _features(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the components, and the root of D times the squared deviations."""
    total = vectors.sum(axis=1)
    return total, _root(vectors.shape[1] * (vectors * vectors).sum(axis=1) - total * total)


class Search:
    """Nearest of the given centroids by squared distance; of equal ones the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.examined = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid of every vector."""
        plain = _plain(vectors, self.centroids)
        kind = np.int64 if plain else object
        vectors, centroids = vectors.astype(kind), self.centroids.astype(kind)
        dimension, count = vectors.shape[1], len(centroids)
        total, root = _features(centroids)
        order = np.lexsort((np.arange(count), total)) if plain else np.array(sorted(range(count), key=lambda c: (total[c], c)))
        total, root, centroids = total[order], root[order], centroids[order]
        mine, mine_root = _features(vectors)
        right = np.searchsorted(total, mine)
        left = right - 1
        best, found = np.full(len(vectors), -1, kind), np.full(len(vectors), count)
        open_ = np.arange(len(vectors))
        while len(open_):
            lo, hi = left[open_], right[open_]
            below, above = mine[open_] - total[np.maximum(lo, 0)], total[np.minimum(hi, count - 1)] - mine[open_]
            go_left = (lo >= 0) & ((hi >= count) | (below <= above))
            at = np.where(go_left, lo, np.minimum(hi, count - 1))
            apart = np.where(go_left, below, above)
            none = best[open_] < 0
            within = none | (apart * apart <= dimension * best[open_])
            going = within & ((lo >= 0) | (hi < count))  # the other side's mean is no nearer, so the whole search ends
            open_, at, go_left, apart, none = open_[going], at[going], go_left[going], apart[going], none[going]
            left[open_] -= go_left
            right[open_] += ~go_left
            spread = np.maximum(np.abs(mine_root[open_] - root[at]) - 1, 0)
            look = none | (apart * apart + spread * spread <= dimension * best[open_])
            row, which = open_[look], at[look]
            self.examined += len(row)
            step = vectors[row] - centroids[which]
            distance = (step * step).sum(axis=1)
            nearer = (best[row] < 0) | (distance < best[row]) | ((distance == best[row]) & (order[which] < found[row]))
            best[row[nearer]], found[row[nearer]] = distance[nearer], order[which[nearer]]
        return found.astype(np.int64), best


def _whole(docs: DataFrame, vec_id: str, embedding: str, dimension: int, scale: int) -> DataFrame:
    """Columns file, row, vec_id, v: the kept vectors as whole numbers."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vector_portions(batches):
            for length, rows, found in by_length(batch.column("embedding")):
                if length != dimension:
                    continue
                with np.errstate(over="ignore"):
                    scaled = np.floor(found.astype(np.float64) * scale)
                fits = (np.abs(scaled) < LARGEST).all(axis=1)
                v = [line.tobytes() for line in scaled[fits].astype("<i8")]
                kept = batch.take(pa.array(rows[fits]))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("file", "row", "vec_id")), pa.array(v, pa.binary())], names=["file", "row", "vec_id", "v"])

    rows = keyed(docs, F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = dict(rows.dtypes)["vec_id"]
    return in_tasks(rows, per_batch, f"file long, row long, vec_id {kind}, v binary")


def _start(kept: DataFrame, dimension: int, count: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(name, 256).alias("name"), "v").orderBy("name", "v").limit(count).collect()
    return np.array([np.frombuffer(bytes(r["v"]), "<i8") for r in first], np.int64).reshape(len(first), dimension)


def _sums(kept: DataFrame, centroids: np.ndarray) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Vectors per centroid, and the sum of each of their components. Leaves a task as one row per sum."""
    given = kept.sparkSession.sparkContext.broadcast(centroids)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(given.value)
        total = np.zeros((len(given.value), given.value.shape[1] + 1), object)
        for batch in batches:
            for part in vector_portions([batch]):
                vectors = _numbers(part.column("v"))
                cluster, _ = search.nearest(vectors)
                if not _plain(vectors):
                    vectors = vectors.astype(object)
                for c in np.unique(cluster):
                    mine = vectors[cluster == c]
                    total[c, :-1] += mine.sum(axis=0)
                    total[c, -1] += len(mine)
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array([Decimal(int(n)) for n in total[c, at]], pa.decimal128(38, 0))], names=["cluster", "at", "n"]
        )

    rows = in_tasks(kept.select("v"), per_task, "cluster int, at int, n decimal(38,0)").groupBy("cluster", "at").agg(F.sum("n").alias("n")).collect()
    given.unpersist()
    sums = {(r["cluster"], r["at"]): int(r["n"]) for r in rows}
    last = centroids.shape[1]
    return {c: n for (c, at), n in sums.items() if at == last}, sums


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    counts, sums = _sums(kept, centroids)
    out = centroids.copy()
    for c, n in counts.items():
        out[c] = [sums.get((c, at), 0) // n for at in range(centroids.shape[1])]
    return out


def centroid_clusters(
    spark: SparkSession,
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    dimension: int = DIMENSION,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per kept vector: its cluster, its squared distance to the centroid, and sums of these.

    Kept are vectors of exactly ``dimension`` components, none null or non-finite; each becomes
    floor(scale * component). One with a component beyond 2^58 after that is left out too, as not being a
    whole number this method counts with. Centroids start as the ``count`` kept rows with the smallest SHA-256 of
    ``seed:vec_id`` (a null id counts as empty; of rows with one id the smaller vector in byte order comes first,
    and each counts); fewer rows give fewer centroids. A centroid without vectors stays. Repeated rows are rows of
    their own; an empty table, or one without a kept vector, gives an empty result. Sums and distances that
    do not fit a long are null. Other columns are not read.
    Columns: file, row, vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    folder = shared_folder(spark)
    kept = stored(_whole(vectors, vec_id, embedding, dimension, scale), folder, "kept")
    centroids = _start(kept, dimension, count, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids)
    given = spark.sparkContext.broadcast(centroids)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(given.value)
        for batch in vector_portions(batches):
            cluster, distance = search.nearest(_numbers(batch.column("v")))
            exact = pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "row", "vec_id")), pa.array(cluster.astype(np.int32)), exact], names=["file", "row", "vec_id", "cluster", "exact"])

    kind = dict(kept.dtypes)["vec_id"]
    found = stored(in_tasks(kept, per_batch, f"file long, row long, vec_id {kind}, cluster int, exact decimal(38,0)"), folder, "found")
    sums = {r["cluster"]: _LONG if r["n"] is None else int(r["n"]) for r in found.groupBy("cluster").agg(F.expr("try_sum(exact)").alias("n")).collect()}
    whole = sum(sums.values())
    as_long = lambda n: n if n < _LONG else None
    digest = lambda c: hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()
    facts = spark.createDataFrame(
        [(c, as_long(n), as_long(whole), digest(c)) for c, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )  # one row per centroid
    return found.join(F.broadcast(facts), "cluster").select(
        "file", "row", "vec_id", "cluster", F.expr("try_cast(exact AS long)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )
