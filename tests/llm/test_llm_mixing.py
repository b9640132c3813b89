from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm import mixing
from bazaarlens.llm.mixing import mix_sources, mixed_documents


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows, most=3):
    """Shared by weight again and again, until nothing is above its limit."""
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += words(r[1])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(size.values())
    while True:
        left = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / (sum(weight[s] for s in left) or 1)
        over = [s for s in left if weight[s] * level > most * size[s]]
        if not over:
            return size, {s: fixed.get(s, weight[s] * level) for s in order}
        fixed |= {s: most * size[s] for s in over}


@pytest.mark.parametrize(("bins", "on_disk"), [(1, True), (64, False), (1 << 14, True)])
def test_targets_and_totals(spark, tmp_path, monkeypatch, bins, on_disk):
    monkeypatch.setattr(mixing, "BINS", bins)
    rows = [r for r in odd_rows(8, 120) if words(r[1]) < 10_000]
    docs = frame(spark, rows, tmp_path if on_disk else None)
    got = mix_sources(spark, docs).collect()
    size, target = targets(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) <= 1e-6 * max(1, r.target)
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, wanted in target.items():
        assert abs(taken[s] - wanted) <= 12, (s, taken[s], wanted)
    if bins == 64:
        again = mix_sources(spark, docs).collect()
        assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((r.doc_id, r.source, r.size, r.taken) for r in again)


def test_small_sources_stop_at_three_copies(spark):
    rows = [(i, "w " * 10, None, "big", 1) for i in range(200)] + [(500, "a b c", None, "tiny", 1), (501, None, None, "void", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in mix_sources(spark, docs).collect()}
    assert got[500].target == 9 and got[500].taken == 9
    assert got[501].target == 0 and got[501].taken == 0
    assert abs(sum(r.taken for r in got.values() if r.source == "big") - (2003 - 9)) <= 6


def test_the_chance_grows_with_preference(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', 10) AS text", "if(id < 2000, 's', 't') AS source")
    got = mix_sources(spark, docs, preference=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).toPandas()
    s = got[got["source"] == "s"]  # target two thirds of its size
    assert abs(s["taken"].sum() - s["target"].iloc[0]) <= 10
    assert s[s["doc_id"] % 2 == 0]["taken"].mean() > 1.3 * s[s["doc_id"] % 2 == 1]["taken"].mean()


def test_the_mix_holds_every_copy(spark, tmp_path):
    rows = odd_rows(10, 40)
    docs = frame(spark, rows, tmp_path)
    want = Counter()
    for r in mix_sources(spark, docs).collect():
        want[r.doc_id, r.size] += r.copies
    out = mixed_documents(spark, docs)
    assert set(docs.columns) <= set(out.columns)
    assert Counter((r["doc_id"], words(r["text"])) for r in out.collect()) == +want
    assert mixed_documents(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_sources(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_document_does_not_end_the_sample(spark):
    """Nine sources of 300 documents of 20 to 40 words, each with a document of 5,000 words somewhere in the order."""
    rows = [(s * 1000 + i, "w " * (5000 if i == 0 else 20 + (i * 7 + s) % 21), None, f"s{s}", 1) for s in range(9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    off = {r.source: r.d for r in mix_sources(spark, docs).groupBy("source").agg({"taken": "sum", "target": "max"}).selectExpr("source", "abs(`sum(taken)` - `max(target)`) AS d").collect()}
    assert len(off) == 9 and max(off.values()) <= 20, off


def test_inclusion_follows_the_chances(spark):
    """200 sources of the same 400 documents are 200 draws: each document is taken as often as its chance says."""
    lengths = [15 + (i * i) % 97 for i in range(400)]
    docs = spark.range(80_000).selectExpr(
        "id AS doc_id", "repeat('w ', cast(15 + (id % 400) * (id % 400) % 97 AS int)) AS text", "concat('s', lpad(id div 400, 3, '0')) AS source"
    )
    got = mix_sources(spark, docs).toPandas()
    got["turn"] = (got["doc_id"] // 400) % 3
    assert got["source"].nunique() == 200 and len(got) == 80_000
    mean = sum(lengths) / len(lengths)
    for turn, weight in enumerate((1, 2, 3)):  # 67, 67 and 66 sources
        target = 200 * sum(lengths) * weight / (67 + 2 * 67 + 3 * 66)
        wanted = [2 ** (round(8 * min(1, max(-1, 0.5 * math.log2(mean / n)))) / 8) for n in lengths]
        low, high = 0.0, 100.0
        for _ in range(80):  # no document is wanted more than three times
            level = (low + high) / 2
            low, high = (low, level) if sum(n * min(3, level * w) for n, w in zip(lengths, wanted, strict=True)) > target else (level, high)
        wanted = [min(3, level * w) for w in wanted]
        mine = got[got["turn"] == turn]
        assert (mine.groupby("source")["taken"].sum() - target).abs().max() <= 15  # the shortest document
        by_document = mine.assign(place=mine["doc_id"] % 400).groupby("place")["copies"]
        z = []
        for i, (n, w) in enumerate(zip(lengths, wanted, strict=True)):
            copies = by_document.get_group(i)
            assert set(copies) <= {int(w + 1e-9), int(w + 1e-9) + 1}, (i, w)
            p = w % 1
            off = copies.mean() - w
            if n >= 40:
                z.append(off / max((p * (1 - p) / len(copies)) ** 0.5, 0.02))
            else:  # the gap at the end of a sample is filled with short documents, so they are taken more often
                assert -0.25 < off < 0.4, (i, n, off)
        assert len(z) > 250 and max(map(abs, z)) < 4.5 and sum(x * x for x in z) / len(z) < 1.4, (turn, z)


def test_the_histogram_inside_the_last_bin(spark, monkeypatch):
    """With two bins, and one of them split, the ends are the same as with many."""
    rows = [(i, "w " * (3 + i % 11), f"s{i % 4}") for i in range(400)] + [(9, "w " * 3, "s1")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    many = Counter((r.doc_id, r.source, r.taken) for r in mix_sources(spark, docs).collect())
    monkeypatch.setattr(mixing, "BINS", 2)
    assert many == Counter((r.doc_id, r.source, r.taken) for r in mix_sources(spark, docs).collect())
