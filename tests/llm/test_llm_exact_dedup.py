from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm import exact_dedup as module
from bazaarlens.llm.exact_dedup import drop_copies, exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out[i, keep, len(ids), bool(left), hashlib.sha256(text.encode()).hexdigest()] += 1
            left = 0
    return out


@pytest.mark.parametrize(("fan_in", "on_disk"), [(2, True), (16, False)])
def test_against_groups(spark, tmp_path, monkeypatch, fan_in, on_disk):
    monkeypatch.setattr(module, "FAN_IN", fan_in)
    rows = odd_rows()
    docs = frame(spark, rows, tmp_path if on_disk else None, 9)
    got = exact_dedup(spark, docs).drop("file", "row")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_one_row_of_each_text_stays(spark, tmp_path):
    rows = odd_rows(2)
    docs = frame(spark, rows, tmp_path)
    kept = drop_copies(spark, docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert Counter(normal(r.text) for r in found) == Counter({normal(r[1]): 1 for r in rows})
    by_text = {normal(r.text): r.doc_id for r in found}
    for text, keep in by_text.items():
        assert keep == min((r[0] for r in rows if normal(r[1]) == text and r[0] is not None), default=None)
    assert Counter(map(tuple, found)) <= Counter(rows)


def test_empty_and_no_copies(spark):
    assert exact_dedup(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(7, "a")], "doc_id long, text string")
    assert [tuple(r)[2:6] for r in exact_dedup(spark, one).collect()] == [(7, 7, 1, True)]


def test_a_hot_text_is_reduced_in_its_partitions(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text").repartition(12).write.parquet(str(tmp_path / "hot"))
    got = exact_dedup(spark, spark.read.parquet(str(tmp_path / "hot")))
    assert got.filter("group_size > 1").selectExpr("min(keep_id)", "max(keep_id)", "max(group_size)", "count(*)", "count_if(kept)").first() == (0, 0, 1334, 1334, 1)


def test_a_long_list_of_dropped_rows_is_not_broadcast(spark, tmp_path, monkeypatch):
    from bazaarlens.llm import shared

    spark.range(100).selectExpr("id AS doc_id", "concat('t', id % 50) AS text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for most, node in ((500_000, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        kept = drop_copies(spark, docs)
        assert kept.count() == 50
        assert node in kept._jdf.queryExecution().executedPlan().toString()
