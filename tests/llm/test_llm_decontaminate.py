from __future__ import annotations

import hashlib
import random
import re

import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm import words
from bazaarlens.llm.decontaminate import decontaminate, drop_contaminated, matches, test_items as items_of


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(text, items, window=10):
    found, hit, listed = split(text), set(), set()
    for item, item_text in items:
        own = split(item_text)
        n = min(window, len(own))
        for j in range(max(1, len(own) - window + 1) if own else 0):
            for p in range(len(found) - n + 1):
                if found[p : p + n] == own[j : j + n]:
                    hit |= set(range(p, p + n))
                    listed.add(item)
    ids = sorted(str(i) for i in listed if i is not None)
    return len(found), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_places_of_random_matches():
    rng = random.Random(3)
    for _ in range(150):
        vocabulary = ["a", "b", "c", "dd", "ee", "zz"][: rng.randint(1, 6)]
        window = rng.choice([1, 2, 3, 10])
        docs = [" ".join(rng.choice([*vocabulary, "q7"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8)))) for i in range(rng.randint(0, 5))]
        n, hit, found = matches([d.encode() for d in docs], items_of(items, window), window)
        for i, doc in enumerate(docs):
            assert (n[i], hit[i]) == expected(doc, items, window)[:2]
            longest = [m for m in found.tolist() if m[0] == i]
            for _, item, at, word, length in longest:
                own = items[item][1].split()
                assert doc.split()[at : at + length] == own[word : word + length]
                if len(own) >= window:  # none can be made longer
                    assert at + length == len(doc.split()) or word + length == len(own) or doc.split()[at + length] != own[word + length]


@pytest.mark.parametrize("block", [1, 60, 1 << 24])
def test_against_brute_force(spark, tmp_path, block):
    rows = odd_rows(5, 25)
    long_text = next(r[1] for r in rows if r[1] and len(r[1]) > 50_000)
    items = [(0, " ".join(long_text.split()[100:130])), (1, "cat sat"), (2, None), (3, "..!"), (None, "señor"), (12, "ONE"), (12, "ONE"), (4, "nowhere to be found"), (5, " ".join(["the"] * 12))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, file string")
    got = decontaminate(spark, frame(spark, rows, tmp_path), bench, block_bytes=block)
    want = sorted((repr(r[0]), *expected(r[1], items)) for r in rows)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want


def test_stage_and_empty_tables(spark, tmp_path):
    rows = odd_rows(6, 20)
    docs = frame(spark, rows, tmp_path)
    bench = spark.createDataFrame([(1, "cat sat")], "item_id long, text string")
    kept = drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in rows if not expected(r[1], [(1, "cat sat")])[-1])
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(spark, docs, none).filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0
    assert decontaminate(spark, spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_words_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab Zé日-") for _ in range(rng.randint(0, 400))).encode() for _ in range(30)] + [b"w" * 5000]
    whole = [x.tolist() for x in words.word_hashes(texts)]
    for limit in (1, 7, 64):
        parts = [words.runs(p, words.LETTERS)[4:6] for p in words.slices(texts, words.LETTERS, limit)]
        assert [h for _, hashes in parts for h in hashes.tolist()] == whole[0]
        assert [t for text, _ in parts for t in text.tolist()] == whole[1]
    for word in (b"Abc", "über".encode(), b"w" * 5000):
        assert words.word_hashes([word])[0].tolist() == [words.hash_of(word)]
