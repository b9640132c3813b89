from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from bazaarlens.llm.centroids import Search, centroid_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, file string, cluster string, v string"


def brute(rows, dimension, count, rounds, scale=256, seed=2):
    """Python integers all the way."""
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dimension and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(scale * x) if abs(x) < 2**50 else None for x in e]
            if None not in v:
                kept.append((vec_id, v))
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), np.array(kept[i][1]).tobytes()))
    centroids = [kept[i][1] for i in order[:count]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((away(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, found, strict=True) if c == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(*row, *nearest(row[1])) for row in kept]
    inertia = {}
    for *_, d, c in last:
        inertia[c] = inertia.get(c, 0) + d
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), digest(c)) for i, _, d, c in last)


def got(spark, rows, tmp_path=None, **options):
    df = spark.createDataFrame([(i, e, 1, "f", "c", "v") for i, e in rows], SCHEMA)
    if tmp_path is not None:
        df.repartition(4).write.parquet(str(tmp_path / "e"))
        df = spark.read.parquet(str(tmp_path / "e"))
    out = centroid_clusters(spark, df, **options).collect()
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out)


@pytest.mark.parametrize("on_disk", [True, False])
def test_against_brute_force(spark, tmp_path, on_disk):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 8) / 4).tolist()) for i in range(300)]  # many ties
    rows += [(None, [0.5] * 8), (None, [0.25] * 8), (7, [0.1] * 8), rows[5], rows[5]]
    rows += [(900, None), (901, []), (902, [1.0] * 7), (903, [None] * 8), (904, [math.nan] + [0.0] * 7), (905, [math.inf] + [0.0] * 7)]
    want = brute(rows, 8, 12, 4)
    assert got(spark, rows, tmp_path if on_disk else None, dimension=8, count=12, rounds=4) == want and len(want) == 305


def test_large_numbers_and_few_rows(spark):
    rows = [(1, [1e6, -1e6]), (2, [1e6, 1.5]), (3, [3.25e5, -2.0]), (4, [1e6 + 1, -1e6]), (5, [1e300, 0.0])]
    want = brute(rows, 2, 2, 3)
    assert got(spark, rows, dimension=2, count=2, rounds=3) == want and len(want) == 4
    assert got(spark, [(1, [2.0, 3.0])], dimension=2) == brute([(1, [2.0, 3.0])], 2, 40, 5)
    assert got(spark, [], dimension=2) == [] and got(spark, [(1, None)]) == []
    beyond = got(spark, [(1, [1e14, 0.0]), (2, [-1e14, 0.0])], dimension=2, count=1, rounds=1)
    assert [r[2] for r in beyond] == [None, None]  # the squares pass 64 bits


def test_search_is_exact_and_passes_centroids_over():
    rng = np.random.default_rng(4)
    for span in (3, 4000, 1 << 23, 1 << 40):
        kind = object if span > 1 << 24 else np.int64
        centroids, vectors = rng.integers(-span, span, (30, 16)), rng.integers(-span, span, (200, 16))
        vectors = np.concatenate((vectors, centroids, (vectors[:20] + centroids[:20]) // 2))
        search = Search(centroids)
        cluster, distance = search.nearest(vectors)
        every = ((vectors[:, None].astype(kind) - centroids[None].astype(kind)) ** 2).sum(axis=2)
        best = every.min(axis=1)
        assert (distance == best).all() and (cluster == [(row == b).argmax() for row, b in zip(every, best, strict=True)]).all()
    spread = rng.integers(-50, 50, (4000, 16)) + rng.integers(-2000, 2000, (4000, 1))
    search = Search(spread[:100].astype(np.int64))
    search.nearest(spread.astype(np.int64))
    assert search.examined < 0.1 * 4000 * 100
