from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm.components import components
from bazaarlens.llm.shared import shared_folder
from bazaarlens.llm.simhash import drop_near_copies, linked, simhash_groups


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, most=3):
    """Smallest place reachable over links of at most ``most`` bits."""
    f = np.array(prints, np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= most):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            root[b] = a
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("on_disk", [True, False])
def test_against_brute_force(spark, tmp_path, on_disk):
    rows = odd_rows(3)
    got = simhash_groups(spark, frame(spark, rows, tmp_path if on_disk else None)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    component = {}
    for r, root in zip(rows, roots(prints), strict=True):
        component.setdefault(root, []).append(r[0])
    want = sorted(
        (repr(r[0]), f"{p:016x}", repr(min((i for i in component[root] if i is not None), default=None)))
        for r, p, root in zip(rows, prints, roots(prints), strict=True)
    )
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(component) and all(r.doc_id == r.component_id for r in kept)


def _near(rng, n, centres, flips):
    found = set()
    while len(found) < n:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            f ^= 1 << rng.randrange(64)
        found.add(f)
    return sorted(found)


@pytest.mark.parametrize("bucket", [4, 2048])
def test_hot_buckets_are_cut_and_lose_nothing(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = _near(rng, 700, centres, 5) + [rng.getrandbits(64) for _ in range(100)]
    prints += [centres[0] & ~0xFFFFFFFF | rng.getrandbits(32) for _ in range(150)]  # one half in common
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    folder = shared_folder(spark)
    links = linked(df, folder, bucket=bucket).collect()
    root = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long"), folder).collect()}
    want = {}
    for p, r in zip(signed, roots(prints), strict=True):
        want.setdefault(r, set()).add(p)
    got = {}
    for p in signed:
        got.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5002), (5002, 5000), (7, 7)]
    random.Random(1).shuffle(links)
    root = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long"), shared_folder(spark)).collect()}
    assert root == {**dict.fromkeys(range(1, 201), 0), **dict.fromkeys(range(1001, 1300), 1000), 5001: 5000, 5002: 5000}


def test_no_links_and_empty(spark):
    assert components(spark.createDataFrame([], "u long, v long"), shared_folder(spark)).count() == 0
    assert simhash_groups(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays(spark, tmp_path):
    rows = odd_rows(4)
    docs = frame(spark, rows, tmp_path)
    kept = drop_near_copies(spark, docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots([fingerprint(r[1]) for r in rows])))
