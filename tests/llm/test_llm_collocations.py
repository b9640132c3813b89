from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm import collocations as co
from bazaarlens.llm.shared import shared_folder


def brute(rows, threshold, longest=5, kept=2000):
    """The contract, word by word, over (lang, text)."""
    counts, n = {}, Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                of.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = []
    for lang, of in counts.items():
        frequent = {p: f for p, f in of.items() if f >= threshold}
        inside = {}
        for p, f in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside.get(p[i : i + size], 0), f)
        mine = []
        for p, a in frequent.items():
            if len(p) > 1 and inside.get(p, 0) < a:
                score, k = min((1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), frequent[p[:k]], frequent[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:kept], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def prose(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["über", "New", "york", "日本", "x" * 90]
    sets = [["New", "york", "city", "hall"], ["a", "a", "a", "a", "a", "a"], ["san", "jose"], ["in", "the", "end", "of", "time"]]
    out = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 40)):
            text += rng.choice(sets) if rng.random() < 0.3 else [rng.choice(words)]
            text += [rng.choice([",", ".", "\n", ";", "\x0b"])] if rng.random() < 0.1 else []
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(text)))
    return out


def mined(spark, rows, tmp_path=None, **options):
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    if tmp_path is not None:
        df.repartition(3).write.parquet(str(tmp_path / "d"))
        df = spark.read.parquet(str(tmp_path / "d"))
    return sorted(tuple(r) for r in co.collocations(spark, df, **options).collect())


@pytest.mark.parametrize("shards", [1, 3])
def test_against_brute_force(spark, tmp_path, shards):
    rows = prose(shards, 500)
    want = brute(rows, 12, kept=15)
    assert mined(spark, rows, tmp_path, threshold=12, shards=shards, kept=15) == want and len(want) > 40


def test_odd_rows_and_columns(spark, tmp_path):
    rows = odd_rows(21, 80)
    got = sorted(tuple(r) for r in co.collocations(spark, frame(spark, rows, tmp_path), threshold=30).collect())
    assert got == brute([(r[2], r[1]) for r in rows], 30) and got
    assert co.collocations(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert mined(spark, [(None, None), ("en", ""), ("en", " \t"), ("de", ".,;\n")], threshold=1) == []


def test_words_that_share_a_number_get_others(spark, monkeypatch):
    """With numbers of 5 bits nearly all words share one; the counts must be right all the same."""
    real = co.runs

    def weak(parts, classes):
        *rest, found = real(parts, classes)
        return (*rest, found & np.uint64(31) | np.uint64(32))

    rows = prose(7, 60)
    texts, special = [t.encode() for _, t in rows], np.zeros(0, np.uint64)
    monkeypatch.setattr(co, "runs", weak)
    numbers = {}
    for raw, start, end, _, found in co._word_numbers(texts, np.arange(32, 64).astype(np.uint64)):
        for a, b, x in zip(start, end, found, strict=True):
            if x:
                numbers.setdefault(int(x), set()).add(raw[a:b].tobytes().lower())
    assert all(len(words) == 1 for words in numbers.values()) and len(numbers) > 30
    odd = [(raw, start, end, found) for raw, start, end, _, found in co._word_numbers(texts, special)][0]
    raw, start, end, found = odd
    same = np.flatnonzero(end - start == 2)
    first = np.full(len(same), start[same[0]])
    told = co._unlike(raw, start[same], (end - start)[same], first)
    assert (told == [raw[start[i] : end[i]].tobytes().lower() != raw[first[0] : first[0] + 2].tobytes().lower() for i in same]).all()


def test_a_phrase_is_counted_for_one_cycle_from_where_both_parts_are_frequent(spark):
    """b comes late: 'a b' starts only after b has reached the threshold, and still gets its full count."""
    schema = "lang string, n long, words binary, shard int"
    a, b, c = (np.uint64(x) for x in (101, 202, 303))
    row = lambda shard, *ws: ("en", len(ws), np.array(ws, np.uint64).tobytes(), shard)
    rows = [row(0, a, b, np.uint64(0)), row(1, a, c, np.uint64(0)), row(2, a, b, c, np.uint64(0), a, b, np.uint64(0))]
    shards, folder = spark.createDataFrame(rows, schema), shared_folder(spark)
    singles, longer = co.frequent_phrases(shards, folder, threshold=2, longest=3, count=3)
    assert sorted((r.w, r.n) for r in singles.collect()) == [(101, 4), (202, 3), (303, 2)]
    assert [r.n for r in longer.collect()] == [3]
    key = lambda *ws: np.array(ws, ">u8").tobytes()
    got = {bytes(r.p): r.n for r in co.exact_counts(shards, singles, longer, 2, 3).collect()}
    assert got == {key(a): 4, key(b): 3, key(c): 2, key(a, b): 3}


def test_tables_let_every_entry_through(spark):
    number = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)
    table = co._table(spark.createDataFrame([(int(x),) for x in number], "number long"), 5000)
    assert co._in(table, number.view(np.uint64)).all() and len(table) * 64 == 1 << 18
    assert co._in(table, np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.05
    assert not co._table(spark.createDataFrame([], "number long"), 0).any()


def test_numbers_shared_by_chance_are_told_apart():
    words = np.array([5, 6, 7, 5, 6, 8], np.uint64)
    at = np.array([0, 1, 3, 4])
    first, n = co._same(words, at, np.array([1, 1, 1, 1], np.uint64), 2)
    assert sorted(zip(map(tuple, (words[f : f + 2].tolist() for f in first)), n.tolist(), strict=True)) == [((5, 6), 2), ((6, 7), 1), ((6, 8), 1)]


def test_bits_set_by_chance_lose_no_phrase(spark, monkeypatch):
    """b becomes frequent late. If its bit was set by another word before, 'a b' must still be counted for a whole cycle."""
    monkeypatch.setattr(co, "_BITS", (1 << 6, 1 << 28))
    monkeypatch.setattr(co, "_EACH", 4)
    rng = random.Random(3)
    units = [u for i in range(400) for u in [f"a{i} b{i}"] * rng.randint(10, 13) + [f"a{i}"] * rng.randint(0, 30)]
    rng.shuffle(units)
    rows = [("en", ". ".join(units[at : at + 50])) for at in range(0, len(units), 50)]
    assert mined(spark, rows, threshold=10) == brute(rows, 10)


def test_a_task_hands_on_each_phrase_once(spark, monkeypatch):
    """Counts of many batches and languages are added up in the task; few or many phrases held give the same rows."""
    schema = "lang string, n long, words binary, shard int"
    rng = np.random.default_rng(4)
    rows = [(lang, 9, np.append(rng.integers(1, 4, 9), 0).astype(np.uint64).tobytes(), 0) for lang in ["en", "de"] * 300]
    shards = spark.createDataFrame(rows, schema).coalesce(1)
    singles, longer = co.frequent_phrases(shards, shared_folder(spark), threshold=20, longest=3, count=1)
    got = []
    for held in (1 << 19, 8):
        monkeypatch.setattr(co, "_HELD", held)
        got.append(sorted((r.lang, bytes(r.p), r.n) for r in co.exact_counts(shards, singles, longer, 20, 3).collect()))
    assert got[0] == got[1] and len(got[0]) == 2 * (3 + 9 + 27)
    parts = co._Held()
    for n in (1, 2):
        parts.add("en", 2, np.array([7, 7, 9], np.uint64), np.array([1, 2, 3, 4, 1, 2], np.uint64), np.array([n, n, n]))
    parts.add_up()
    ((number, words, n),) = parts.parts["en", 2]
    assert sorted(zip(map(tuple, words.reshape(-1, 2).tolist()), n.tolist(), strict=True)) == [((1, 2), 6), ((3, 4), 3)]


def test_rows_of_the_last_scan(spark, monkeypatch):
    """A frequent phrase is one row for each of a few tasks, however many files there are, and hardly a rare one is told."""
    monkeypatch.setattr(co, "_BITS", (1 << 6, 1 << 28))
    schema = "lang string, n long, words binary, shard int"
    rng = np.random.default_rng(5)
    often, zero = np.arange(1, 401, dtype=np.uint64), np.zeros(1, np.uint64)
    rows = []
    for _ in range(400):
        # Some 480 times each of 400 words, in pairs of any two, all of them rare; and 40 pairs that always stay together.
        words = np.concatenate([np.append(rng.choice(often, 8), zero) for _ in range(60)] + [np.array([500 + 2 * k, 501 + 2 * k, 0], np.uint64) for k in range(40)])
        rows.append(("en", int((words > 0).sum()), words.tobytes(), 0))
    shards = spark.createDataFrame(rows, schema).repartition(40)
    singles, longer = co.frequent_phrases(shards, shared_folder(spark), threshold=100, longest=2, count=1)
    given, real = [], co.in_tasks

    def told(df, per_task, schema):
        given.append(real(df, per_task, schema))
        return given[-1]

    monkeypatch.setattr(co, "in_tasks", told)
    got = {tuple(np.frombuffer(r.p, ">u8").tolist()): r.n for r in co.exact_counts(shards, singles, longer, 100, 2).collect()}
    pairs = [p for p in got if len(p) == 2]
    assert sorted(pairs) == [(500 + 2 * k, 501 + 2 * k) for k in range(40)] and all(got[p] == 400 for p in pairs) and len(got) == 40 + 480
    rows_told = given[0].groupBy("p").count().collect()
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in rows_told if bytes(r.p) in {np.array(p, ">u8").tobytes() for p in pairs}) <= tasks * 40
    assert len(rows_told) < 40 + 0.005 * 160_000
