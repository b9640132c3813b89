from __future__ import annotations

import pickle
import re

import numpy as np
import pytest
from rows import SCHEMA, frame, odd_rows

from bazaarlens.llm import lm
from bazaarlens.llm.lm import Trainer, count_words, lm_scores, log_likelihood, start_weights, words_of
from bazaarlens.llm.shared import filled, keyed, shared_folder
from bazaarlens.llm.words import LETTERS, hash_of, word_hashes


def counts_of(texts):
    hashes, _ = word_hashes(texts)
    return np.bincount(lm._hashed(hashes, lm.WORD_BITS), minlength=1 << lm.WORD_BITS)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(3000).collect()]


def test_held_out_words_are_likelier_than_alone(texts):
    words = words_of(counts_of(texts[:2500]))
    trainer = Trainer(start_weights(words))
    hashes, text = word_hashes(texts[:2500])
    for _ in range(2):
        trainer.learn(hashes, text, words)
    n, total = log_likelihood(texts[2500:], words, trainer.weights)
    place = lm._hashed(word_hashes(texts[2500:])[0], lm.WORD_BITS)
    alone = (words.share[place] + words.prior[words.kind[place]]).mean()
    assert total.sum() / n.sum() > alone + 0.05


def test_every_position_is_learnt(texts):
    hashes, text = word_hashes(texts[:100])
    words = words_of(counts_of(texts[:100]))
    trainer = Trainer(start_weights(words))
    trainer.learn(hashes, text, words)
    assert trainer.learnt == len(hashes)


def test_both_sides_are_learnt():
    """The middle word is given by its left neighbour alone, or by its right one alone."""
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(3000):
        k = rng.integers(0, 8)
        rows.append(f"l{k} m{k} x" if rng.random() < 0.5 else f"x m{k} r{k}")
    texts = [r.encode() for r in rows]
    words = words_of(counts_of(texts))
    trainer = Trainer(start_weights(words))
    hashes, text = word_hashes(texts)
    for _ in range(12):
        trainer.learn(hashes, text, words)
    right, wrong = (log_likelihood([t.encode()], words, trainer.weights)[1][0] for t in ("l3 m3 x", "l3 m4 x"))
    assert right > wrong + 1
    right, wrong = (log_likelihood([t.encode()], words, trainer.weights)[1][0] for t in ("x m5 r5", "x m6 r5"))
    assert right > wrong + 1


def test_sums_of_single_words(texts):
    words = words_of(counts_of(texts[:50]))
    rng = np.random.default_rng(2)
    weights = {k: rng.standard_normal(v.shape).astype(np.float32) * 0.3 for k, v in start_weights(words).items()}
    some = [texts[0][:400], b"", b"One", "Zwei Wörter".encode(), b"..."]
    n, total = log_likelihood(some, words, weights)
    pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    for text, count, got in zip(some, n, total, strict=True):
        hashes = [hash_of(w) for w in pattern.findall(text)]
        assert count == len(hashes)
        want = 0.0
        for i, h in enumerate(hashes):
            hidden = weights["hidden"].astype(float)
            for k, place in enumerate(lm._PLACES):
                inside = 0 <= i + place < len(hashes)
                hidden = hidden + weights["near"][k][(hashes[i + place] >> (64 - lm.CONTEXT_BITS)) if inside else lm._CONTEXT]
            score = np.tanh(hidden) @ weights["out"] + weights["bias"]
            word = h >> (64 - lm.WORD_BITS)
            want += score[words.kind[word]] - np.log(np.exp(score).sum()) + words.share[word]
        assert abs(got - want) < 1e-3 * max(1, count)


def test_classes_are_a_distribution():
    words = words_of(np.random.default_rng(3).integers(0, 50, 1 << lm.WORD_BITS))
    assert np.allclose(np.bincount(words.kind, np.exp(words.share)), 1)
    assert np.isclose(np.exp(words.prior).sum(), 1) and len(np.unique(words.kind)) == lm.CLASSES


def test_counts_and_averages_over_tasks(spark, tmp_path, monkeypatch):
    rows = odd_rows(14, 40)
    docs = frame(spark, rows, tmp_path, 7)
    from pyspark.sql import functions as F

    narrow = keyed(docs, F.col("doc_id"), F.col("text"))
    texts = [(r[1] or "").encode() for r in rows]
    counts = count_words(narrow)
    assert (counts == counts_of(texts)).all()
    words = words_of(counts)
    wide = lm.train(narrow, words, shared_folder(spark))
    monkeypatch.setattr(lm, "FAN_IN", 2)
    deep = lm.train(narrow, words, shared_folder(spark))
    assert all(np.allclose(wide[k], deep[k], atol=1e-5) for k in wide)
    assert any((wide[k] != start_weights(words)[k]).any() for k in wide)
    assert filled is not None and LETTERS[ord("a")]


@pytest.mark.parametrize("on_disk", [True, False])
def test_odd_rows(spark, tmp_path, on_disk):
    rows = odd_rows(15, 20)
    docs = frame(spark, rows, tmp_path if on_disk else None)
    got = lm_scores(spark, docs).collect()
    count = lambda t: len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()))
    assert sorted((repr(r.doc_id), r.n_words) for r in got) == sorted((repr(r[0]), count(r[1])) for r in rows)
    for r in got:
        assert (r.mean_log_probability is None) == (r.n_words == 0)
        assert r.log_likelihood < 0 if r.n_words else r.log_likelihood == 0
    assert lm_scores(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_one_class_are_told_apart():
    """400 words, each given by its left neighbour; exchanging two of one class must cost."""
    rng = np.random.default_rng(1)
    texts = [f"l{k} m{k} x".encode() for k in rng.integers(0, 400, 6000)]
    words = words_of(counts_of(texts))
    trainer = Trainer(start_weights(words))
    hashes, text = word_hashes(texts)
    for _ in range(12):
        trainer.learn(hashes, text, words)
    kind = lambda w: words.kind[hash_of(w.encode()) >> (64 - lm.WORD_BITS)]
    alike = [(a, b) for a in range(60) for b in range(a + 1, 60) if kind(f"l{a}") == kind(f"l{b}") >= lm.OWN_CLASSES and kind(f"m{a}") == kind(f"m{b}") >= lm.OWN_CLASSES]
    assert alike
    score = lambda *rows: log_likelihood([r.encode() for r in rows], words, trainer.weights)[1].sum()
    gains = [score(f"l{a} m{a} x", f"l{b} m{b} x") - score(f"l{a} m{b} x", f"l{b} m{a} x") for a, b in alike]
    assert np.median(gains) > 2, gains


def test_ways_without_training_give_the_shares():
    words = words_of(np.random.default_rng(3).integers(0, 50, 1 << lm.WORD_BITS))
    some = np.random.default_rng(4).integers(0, 1 << lm.WORD_BITS, 1000)
    weights = {"fork": np.zeros(lm._SHAPES["fork"], np.float32)}
    got = np.zeros(len(some))
    by_depth, levels = lm._levels(words, some)
    for fork, right in levels:
        odds = words.odds[fork] + np.einsum("ij,ij->i", np.zeros((len(fork), lm.HIDDEN), np.float32), weights["fork"][fork])
        got[by_depth[: len(fork)]] -= np.logaddexp(0, np.where(right, -odds, odds))
    assert np.allclose(got, words.share[some], atol=1e-4)


def scores(spark, rows, parts, tmp_path):
    path = str(tmp_path / f"in{parts}")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(path)
    return {r.doc_id: r.mean_log_probability for r in lm_scores(spark, spark.read.parquet(path)).collect()}


def test_scores_do_not_depend_on_files(spark, tmp_path, texts, monkeypatch):
    """Several groups and rounds, and a text with many copies, from 1, 8 and 64 files."""
    monkeypatch.setattr(lm, "GROUP_WORDS", 1 << 14)
    monkeypatch.setattr(lm, "COPIES", 5)
    rows = [(i, t.decode()) for i, t in enumerate(texts[:400])] + [(1000 + k, texts[1].decode()) for k in range(150)]
    one, eight, many = (scores(spark, rows, n, tmp_path) for n in (1, 8, 64))
    assert one.keys() == eight.keys() == many.keys()
    known = [i for i, s in one.items() if s is not None]
    assert max(max(abs(one[i] - eight[i]), abs(one[i] - many[i])) for i in known) < 1e-5
    assert len({round(one[i], 6) for i in known if i >= 1000}) == 1


def test_copies_are_dealt_out_and_none_lost(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPIES", 4)
    given = ["a"] * 30 + ["b"] * 4 + ["c", None, "", "d"] * 2
    rows = spark.createDataFrame([(t,) for t in given], "text string")
    dealt = lm._dealt(rows, 3, shared_folder(spark)).collect()
    total = {}
    for r in dealt:
        total[r.text] = total.get(r.text, 0) + r.times
    assert total == {"a": 30, "b": 4, "c": 2, "": 4, "d": 2}
    assert sorted((r.group, r.times) for r in dealt if r.text == "a") == [(0, 10), (1, 10), (2, 10)]


def test_gain_over_word_shares_stays_with_many_groups(spark, texts, monkeypatch):
    """More groups learn less from the same texts, but rows keep what the groups that met them have learnt."""
    rows = spark.createDataFrame([(t.decode(),) for t in texts[:2500]], "text string").select("text")
    words = words_of(counts_of(texts[:2500]))
    hashes, _ = word_hashes(texts[:2500])
    place = lm._hashed(hashes, lm.WORD_BITS)
    alone = (words.share[place] + words.prior[words.kind[place]]).mean()
    gains = []
    for size in (1 << 21, 1 << 16, 1 << 14):
        monkeypatch.setattr(lm, "GROUP_WORDS", size)
        n, total = log_likelihood(texts[:2500], words, lm.train(rows, words, shared_folder(spark)))
        gains.append(total.sum() / n.sum() - alone)
    print(gains)
    assert gains[1] > 0.5 * gains[0] and gains[2] > 0.25 * gains[0] > 0


def test_sums_and_scores_agree_with_plain_ones(monkeypatch):
    rng = np.random.default_rng(8)
    values = rng.standard_normal((50, lm.HIDDEN)).astype(np.float32)
    for rows in (rng.integers(0, 5, 200), rng.integers(0, 1000, 200), np.zeros(200, np.int64), np.arange(1)):
        order = np.argsort(rows, kind="stable")
        own, head = np.unique(rows[order], return_index=True)
        got = lm._sums(values, order % 50, head)
        for w, total in zip(own, got, strict=True):
            assert np.allclose(total, values[np.flatnonzero(rows == w) % 50].sum(axis=0), atol=1e-4)
    texts = [b"a b c d e " * 30, b"", b"f", b"b a " * 70]
    words = words_of(counts_of(texts))
    trainer = Trainer(start_weights(words))
    trainer.learn(*word_hashes(texts), words)
    near = log_likelihood(texts, words, trainer.weights)[1]
    monkeypatch.setattr(lm, "_FAR", 0)  # every row by its own largest score
    assert np.allclose(near, log_likelihood(texts, words, trainer.weights)[1], rtol=1e-5)
    x = np.float32([-200, -5, 0, 5, 200])
    assert np.allclose(lm._soft(x), np.logaddexp(0, x.astype(float)), rtol=1e-6)


def test_the_driver_sends_counts_and_keeps_no_ways(spark, texts):
    """Ways of words are worked out by the tasks: what is sent of the words is their counts, and the same ways come of them."""
    counts = counts_of(texts[:200])
    words = words_of(counts)
    sent = pickle.dumps(words)
    assert len(sent) < 1.1 * counts.nbytes
    rows = spark.createDataFrame([(t.decode(),) for t in texts[:200]], "text string")
    weights = lm.train(rows, words, shared_folder(spark))
    assert weights.keys() == lm._SHAPES.keys() and all(weights[k].shape == shape for k, shape in lm._SHAPES.items())
    assert "ways" not in vars(words) and len(pickle.dumps(words)) == len(sent)
    there = pickle.loads(sent)
    assert all((getattr(there, k) == getattr(words, k)).all() for k in ("kind", "share", "prior", "first", "forks", "right", "odds")) and there.total == words.total
    # Each word's way through the stretches of its class, one word after another.
    order, upto = np.argsort(-(counts + 1.0), kind="stable"), np.concatenate(([0.0], np.cumsum(np.sort(counts + 1.0)[::-1])))
    kind = words.kind[order]
    for place in (0, lm.OWN_CLASSES, 500, 70_000, len(order) - 1):
        low, high = np.searchsorted(kind, kind[place]), np.searchsorted(kind, kind[place], side="right")
        way = []
        while high - low > 1:
            cut = int(np.clip(np.searchsorted(upto, (upto[low] + upto[high]) / 2), low + 1, high - 1))
            way.append((cut, place >= cut))
            low, high = (cut, high) if place >= cut else (low, cut)
        at = slice(*words.first[order[place] : order[place] + 2])
        assert [*zip(words.forks[at].tolist(), words.right[at].tolist(), strict=True)] == way


def plainly_learnt(start, hashes, text, words, batch):
    """Weights and positions that learnt a row, one position after another."""
    weights = {k: v.astype(float) for k, v in start.items()}
    squares = {k: np.full(v.shape if k in ("out", "bias", "hidden") else v.shape[:-1], 1e-2) for k, v in weights.items()}
    times = {k: np.zeros(weights[k].shape[:-1], int) for k in ("near", "fork")}
    for first in range(0, len(hashes), batch):
        at = range(first, min(first + batch, len(hashes)))
        gradient = {k: np.zeros(v.shape) for k, v in weights.items()}
        for i in at:
            rows = [int(hashes[i + p]) >> (64 - lm.CONTEXT_BITS) if 0 <= i + p < len(text) and text[i + p] == text[i] else lm._CONTEXT for p in lm._PLACES]
            hidden = np.tanh(weights["hidden"] + sum(weights["near"][k][r] for k, r in enumerate(rows)))
            score = hidden @ weights["out"] + weights["bias"]
            word = int(hashes[i]) >> (64 - lm.WORD_BITS)
            error = np.exp(score - score.max()) / np.exp(score - score.max()).sum() - (np.arange(lm.CLASSES) == words.kind[word])
            inner = weights["out"] @ error
            for fork, right in zip(*(t[words.first[word] : words.first[word + 1]] for t in (words.forks, words.right)), strict=True):
                wrong = 1 / (1 + np.exp(-words.odds[fork] - hidden @ weights["fork"][fork])) - right
                gradient["fork"][fork] += wrong * hidden
                inner += wrong * weights["fork"][fork]
                times["fork"][fork] += 1
            inner *= 1 - hidden**2
            gradient["out"] += np.outer(hidden, error)
            gradient["bias"] += error
            gradient["hidden"] += inner
            for k, r in enumerate(rows):
                gradient["near"][k, r] += inner
                times["near"][k, r] += 1
        for k, g in gradient.items():
            g /= len(at) ** 0.5
            squares[k] += g**2 if k in ("out", "bias", "hidden") else (g**2).mean(axis=-1)
            weights[k] -= lm.RATE * g / np.sqrt(squares[k] if k in ("out", "bias", "hidden") else squares[k][..., None])
    return weights, times


def test_learning_agrees_with_a_plain_one(texts, monkeypatch):
    """Ways of all lengths, several batches, and two calls, between which the first forks are put back into their table."""
    monkeypatch.setattr(lm, "BATCH", 128)
    words = words_of(counts_of(texts[:500]) + counts_of([b"often " * 40_000]))
    hashes, text = word_hashes([texts[0][:2000], b"", b"often", texts[1][:2000], b"not seen before, often"])
    depth = np.diff(words.first)[lm._hashed(hashes, lm.WORD_BITS)]
    assert depth.min() == 0 and ((depth > 0) & (depth < lm.TOP)).any() and depth.max() > lm.TOP and len(hashes) > 2 * lm.BATCH
    rng = np.random.default_rng(5)
    start = {k: (rng.standard_normal(shape) * 0.3).astype(np.float32) for k, shape in lm._SHAPES.items()}
    trainer = Trainer(start)
    for some in (slice(0, 2 * lm.BATCH), slice(2 * lm.BATCH, None)):
        trainer.learn(hashes[some], text[some], words)
    # The second call does not see the words before it, so the plain one learns from the two as from two texts.
    apart = text + 1000 * (np.arange(len(text)) >= 2 * lm.BATCH)
    weights, times = plainly_learnt(start, hashes, apart, words, lm.BATCH)
    for k in lm._SHAPES:
        assert np.allclose(trainer.weights[k], weights[k], atol=2e-5), k
    learnt = {kind: (rows, n) for kind, rows, n, _ in lm._rows_learnt(trainer, words)}
    for kind, name in enumerate(lm._TABLES):
        want = times[name].reshape(-1)
        assert (learnt[kind][0] == np.flatnonzero(want)).all() and (learnt[kind][1] == want[want > 0]).all()


def test_first_forks_are_not_learnt_row_by_row(texts, monkeypatch):
    """Row by row go only the forks below the first levels, less than half of all."""
    words = words_of(counts_of(texts[:2500]))
    hashes, text = word_hashes(texts[:300])
    depth = np.diff(words.first)[lm._hashed(hashes, lm.WORD_BITS)]
    given, step = [], Trainer._step_rows

    def counted(self, name, gradient, rows):
        given.append((name, len(rows)))
        step(self, name, gradient, rows)

    monkeypatch.setattr(Trainer, "_step_rows", counted)
    Trainer(start_weights(words)).learn(hashes, text, words)
    below = sum(n for name, n in given if name == "fork")
    assert below == np.maximum(depth - lm.TOP, 0).sum() < 0.5 * depth.sum()


def test_a_word_that_fills_a_batch(monkeypatch):
    """All positions in one class of the tree, all in an own one, and none."""
    words = words_of(np.random.default_rng(3).integers(1, 50, 1 << lm.WORD_BITS))
    rare = int(np.flatnonzero(words.kind == lm.CLASSES - 1)[0])
    own = int(np.flatnonzero(words.kind == 0)[0])
    for word in (rare, own):
        hashes = np.full(lm.BATCH + 5, word << (64 - lm.WORD_BITS), np.uint64)
        trainer = Trainer(start_weights(words))
        trainer.learn(hashes, np.zeros(len(hashes), np.int64), words)
        rows = {kind: n for kind, _, n, _ in lm._rows_learnt(trainer, words)}
        assert (rows[1] == len(hashes)).all() and len(rows[1]) == np.diff(words.first)[word]
    trainer = Trainer(start_weights(words))
    trainer.learn(np.zeros(0, np.uint64), np.zeros(0, np.int64), words)
    assert not trainer.learnt and not trainer.times["near"].any()
    assert log_likelihood([b"", b"..."], words, trainer.weights)[1].tolist() == [0, 0]
