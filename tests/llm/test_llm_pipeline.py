"""The pipeline against its stages by brute force, and the queries with SQL against DuckDB."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from parity import connect, duck_rows, spark_rows
from test_llm_decontaminate import expected as passages
from test_llm_exact_dedup import normal
from test_llm_mixing import targets, words
from test_llm_simhash import fingerprint, roots

import corpus_pipeline
from bazaarlens.llm.oracle import LLM_SQL
from bazaarlens.llm.queries import LLM_QUERIES
from bazaarlens.llm.quality import graded, quality_grades, train
from bazaarlens.llm.shared import _FOLDERS, clear_folders

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_queries_with_sql(spark, name):
    assert spark_rows(LLM_QUERIES[name](spark, DIR)) == duck_rows(connect(DIR), LLM_SQL[name])


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES] == list(range(1, 14))


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality_grades(docs, train(docs, graded(labels), 3)).filter("kept").collect()}
    rows = [tuple(r) for r in docs.collect() if r.doc_id in kept]

    def stage(number, source):
        name, function = corpus_pipeline.STAGES[number]
        out = function(spark, source, DIR)
        out.write.parquet(str(tmp_path / str(number)))
        return spark.read.parquet(str(tmp_path / str(number)))

    out = stage(0, docs)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(rows)

    first: dict[str, tuple] = {}
    for r in sorted(rows):
        first.setdefault(normal(r[1]), r)
    rows = list(first.values())
    out = stage(1, out)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(rows)

    rows.sort()
    root = roots([fingerprint(r[1]) for r in rows])
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    out = stage(2, out)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(rows)

    rows = [r for r in rows if not passages(r[1], bench)[-1]]
    out = stage(3, out)
    assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(rows)

    swapped = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    size, target = targets(swapped)
    mixed = stage(4, out).collect()
    taken = Counter()
    for r in mixed:
        taken[r.source] += words(r.text)
    assert {r.doc_id for r in mixed} <= {r[0] for r in rows}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    for s, wanted in target.items():
        assert abs(taken[s] - wanted) <= 0.01 * wanted + 20

    whole = corpus_pipeline.run(spark, DIR)
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in mixed)


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 0")
    for number, (_, function) in enumerate(corpus_pipeline.STAGES):
        out = function(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / str(number)))
        assert docs.count() == 0


def test_stored_tables_can_be_cleared(spark):
    clear_folders(spark)
    LLM_QUERIES["op8_source_mixing"](spark, "/root/testdata/sf0.001").count()
    folders = list(_FOLDERS[spark.sparkContext.applicationId])
    clear_folders(spark)
    from pathlib import Path

    assert folders and not any(Path(f.removeprefix("file://")).exists() for f in folders)
