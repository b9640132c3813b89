from __future__ import annotations

import numpy as np
import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm.quality import drop_poor, features, fit, graded, quality_grades, train

DIR = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = graded(spark.read.parquet(f"{DIR}/labels.parquet"))
    model = train(docs, labels.filter("doc_id % 2 = 0"), 3)  # the half not fitted on is what is measured below
    assert (np.diff(model.thresholds) >= 0).all()
    held = quality_grades(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").selectExpr("grade", "kept", "expected_grade").toPandas()
    kept, grade = held.groupby("grade")["kept"].mean(), held.groupby("grade")["expected_grade"].mean()
    assert kept[2] > 0.98 and kept[0] < 0.05 and kept[1] < 0.6
    assert grade[0] < grade[1] < grade[2]


def test_probabilities_follow_the_thresholds():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 600)
    texts = [" ".join(["bad"] * (3 - g) + ["good"] * g + ["the", f"w{rng.integers(0, 50)}"]).encode() for g in grade]
    model = fit(*features(texts), grade, 4)
    above = model.above(texts)
    assert above.shape == (600, 3) and (np.diff(above, axis=1) <= 1e-12).all()
    expected = above.sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.8


def test_features_of_a_long_text_are_those_of_its_words(monkeypatch):
    from bazaarlens.llm import words

    text = ("Alpha beta beta ### GAMMA, delta. " * 400).encode()
    whole = [x.tolist() for x in features([text, b"", text])]
    monkeypatch.setattr(words.slices, "__defaults__", (50,))
    assert [x.tolist() for x in features([text, b"", text])] == whole


@pytest.mark.parametrize("on_disk", [True, False])
def test_odd_rows(spark, tmp_path, on_disk):
    rows = odd_rows(7, 30)
    docs = frame(spark, rows, tmp_path if on_disk else None)
    ids = [r[0] for r in rows if r[0] is not None]
    marks = [(i, 0 if k % 3 == 0 else 1 if k % 3 == 1 else None, k % 2) for k, i in enumerate(ids)] + [(None, 1, 1), (3, 0, 0), (3, 1, None)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")
    got = quality_grades(docs, train(docs, graded(labels), 3)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows)
    wordless = {r[0] for r in rows if not (r[1] or "").strip() and r[0] is not None}
    assert all(not r.kept and r.expected_grade == 0 for r in got if r.doc_id in wordless and r.doc_id not in (3, 5))
    kept = drop_poor(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks in ([], [(1, 1, 0), (2, 1, 0)]):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        assert train(docs, graded(labels), 3) is None
        assert drop_poor(spark, docs, labels).count() == 2
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert drop_poor(spark, spark.createDataFrame([], SCHEMA), labels).count() == 0
