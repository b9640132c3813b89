from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import embedding_near as en
from bazaarlens.llm.embedding_near import bands, embedding_groups, encode, estimates, least_estimate

SCHEMA = "vec_id long, embedding array<{}>, label string, file string, rep string, n_links string"


def brute(rows, cosine=0.93):
    """All pairs, then the smallest id over the links."""
    good = []
    for i, (_, e, label) in enumerate(rows):
        ok = label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
        v = np.array(e, float) if ok else None
        good.append(v / np.abs(v).max() if ok else None)
    links = {i: [] for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                links[i].append(j)
                links[j].append(i)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((repr(rows[i][0]), len(links[i]), repr(least), rows[i][0] == least))
    return sorted(out)


def got(spark, vectors, kind="double", tmp_path=None, **options):
    df = spark.createDataFrame([(*r, "f", "r", "n") for r in vectors], SCHEMA.format(kind))
    if tmp_path is not None:
        df.repartition(4).write.parquet(str(tmp_path / "e"))
        df = spark.read.parquet(str(tmp_path / "e"))
    return sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in embedding_groups(spark, df, **options).collect())


def clustered(rng, n, dimension, spread):
    centres = rng.standard_normal((12, dimension))
    return centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dimension))


def cells(spark, vectors, **options):
    return got(spark, [(i, v, "a") for i, v in enumerate(vectors.tolist())], **options)


@pytest.mark.parametrize("on_disk", [True, False])
def test_against_brute_force_with_odd_rows(spark, tmp_path, on_disk):
    rng = np.random.default_rng(1)
    rows = [(i, v, str(rng.integers(0, 3))) for i, v in enumerate(clustered(rng, 150, 24, 0.2).tolist())]
    v = rows[0][1]
    rows += [rows[3], rows[3], (None, v, "0"), (None, v, "0"), (None, [9.0, 1.0], "z"), (200, v, None), (201, None, "0"), (202, [], "0")]
    rows += [(203, [0.0] * 24, "0"), (204, [None] + v[1:], "0"), (205, [math.nan] + v[1:], "0"), (206, [math.inf] + v[1:], "0"), (207, v[:12], "0")]
    rows += [(208, [x * 1e200 for x in v], "0"), (209, [x * 1e-200 for x in v], "0"), (210, [2 * x for x in v], "0"), (211, [-x for x in v], "0")]
    rows += [(212, [1.0], "0"), (213, [7.0], "0"), (214, [-1.0], "0"), (215, [1.0, -0.0], "0"), (216, [1.0, 0.0], "0"), (0, rows[60][1], "0")]
    assert got(spark, rows, tmp_path=tmp_path if on_disk else None) == brute(rows)
    assert got(spark, []) == []


def test_floats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v, "0") for i, v in enumerate(clustered(rng, 60, 16, 0.2).astype(np.float32).astype(float).tolist())]
    assert got(spark, rows, "float") == brute(rows)


def test_large_buckets_are_cut_and_every_pair_is_compared_once(spark):
    vectors = clustered(np.random.default_rng(3), 400, 24, 0.22)
    want = brute([(i, v, "a") for i, v in enumerate(vectors.tolist())])
    assert sum(r[1] for r in want) > 4000
    assert cells(spark, vectors, cell=16) == want
    assert cells(spark, vectors, cell=150) == want


def test_recall_over_bands_and_nothing_below(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 48))
    other = rng.standard_normal((300, 48))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(base)
    other = unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    t = rng.uniform(0.9, 1, (300, 1))
    vectors = np.concatenate((base, t * base + np.sqrt(1 - t**2) * other))
    want = brute([(i, v, "a") for i, v in enumerate(vectors.tolist())])
    found = cells(spark, vectors, rows=16)
    assert bands(600, rows=16)[0] == 6 and bands(600, rows=16)[1] > 4
    assert all(f[1] <= w[1] for f, w in zip(found, want, strict=True))
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in want)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    a, z = rng.standard_normal((2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code, factor = encode(a)
    for t in (0.0, 0.5, 0.93):
        b = t * a + math.sqrt(1 - t * t) * z
        turned = b @ en.rotation(64, 0)
        signs = np.unpackbits(code, axis=1) * 2.0 - 1
        found = (signs * turned).sum(axis=1) / (factor * 8)
        assert abs(found.mean() - t) < 0.01
        if t == 0.93:
            assert (found >= least_estimate(factor, 64, 0.93)).mean() > 0.999
        if t == 0.0:
            assert (found >= least_estimate(factor, 64, 0.93)).mean() < 0.001
        assert np.allclose(estimates(code[:50], factor[:50], b[:50]).diagonal(), found[:50], atol=1e-5)


def test_bounds_decide_which_pairs_are_worked_out():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((500, 64))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    code, factor = encode(unit)
    rows = pa.table(
        {
            "cell": [bytes(24)] * 500,
            "band": pa.array([0] * 500, pa.int32()),
            "part": pa.array([0] * 500, pa.int32()),
            "rep": [i.to_bytes(16, "big") for i in range(500)],
            "dimension": [64] * 500,
            "copies": [1] * 500,
            "v": [x.tobytes() for x in v],
            "code": [c.tobytes() for c in code],
            "factor": factor,
            "keys": [[0]] * 500,
        }
    )
    links, *_, worked = en._cell_links(rows, 0.93, 4.0)
    assert not links.any() and worked < 10


def test_bands_grow_with_the_logarithm():
    assert bands(1) == (0, 1) and bands(1024) == (0, 1) and bands(1025)[0] == 1
    for n in (10**4, 10**7, 10**10):
        bits, count = bands(n)
        assert n / 2**bits <= 1024 and (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** count <= 0.02
    keys = en.band_keys(np.eye(64), 10, 20)
    assert keys.shape == (64, 20) and keys.max() < 1024 and len(np.unique(keys[:, 0])) > 20
