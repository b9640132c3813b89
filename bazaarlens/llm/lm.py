"""Language-model score of documents: masked pseudo-likelihood under a bidirectional window network.

Every word of a document is predicted from the ``REACH`` words on either side of it, itself masked; the sum of the
log-probabilities scores the document. The network adds a vector for each neighbour (one table per place, words
hashed to ``CONTEXT`` rows), takes the hyperbolic tangent and gives a softmax over word classes. Frequent words are
classes of their own; a word of another class is reached by a binary tree over the class's words, in which every
fork asks the same hidden layer for the side. Forks start from the sides' shares of the corpus's occurrences.

Three passes over all documents: count the words (2^18 hashed counts); train; score. Training runs in numpy. Texts are
dealt by their hash to groups of about ``GROUP_WORDS`` words, and the groups to ``ROUNDS`` rounds. A group starts from the
round's weights and learns from every position of its texts, in order of hash and text; then every row of weights is
averaged over the groups that learnt it, by how many positions of theirs did, and the next round starts from that.
Rows no group learnt stay. So neither files nor tasks nor executors have a part in the result, which depends on the texts
and ``GROUP_WORDS`` alone (sums of doubles may differ in their last bits). A text with more than ``COPIES`` copies is dealt
out over several groups by number, so copies never meet in one. The driver gets one table of counts and, every
round, one set of weights, of fixed sizes. It sends the counts once and each round's weights; the words' ways are worked
out by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, in_tasks, keyed, shared_folder, stored
from bazaarlens.llm.words import as_bytes, portions, word_hashes

REACH = 2
CONTEXT_BITS, WORD_BITS = 13, 18
CLASSES, OWN_CLASSES, HIDDEN = 64, 32, 16
BATCH, RATE = 4096, 0.15
GROUP_WORDS, ROUNDS, COPIES = 1 << 21, 3, 64
_CHUNK = 1 << 19  # words learnt from at a time, a multiple of BATCH
SCORED = 4096  # words scored at a time: their class scores stay in the processor's cache
TOP = 6  # levels of a class's tree whose forks are asked by one product for all of the class's words in a batch
_NODES = (1 << TOP) - 1
FAN_IN = 32  # groups whose weights are added up before those of all
SEED = 42
_PLACES = [k for k in range(-REACH, REACH + 1) if k]
_CONTEXT = 1 << CONTEXT_BITS
_ONES = np.ones(CLASSES, np.float32)
_FAR = 60  # e to the power of minus this is still well above the smallest single
_SHAPES = {"near": (len(_PLACES), _CONTEXT + 1, HIDDEN), "hidden": (HIDDEN,), "out": (HIDDEN, CLASSES), "bias": (CLASSES,), "fork": (1 << WORD_BITS, HIDDEN)}


class Words:
    """What the corpus says about words: the class of each hashed word, its log share of the class and its way there.

    Each of the most frequent words is a class; the others, by frequency, are cut into classes of about equal weight.
    Every hashed word counts once more than it occurs, so words of other corpora have a chance. ``prior`` has the log
    share of each class, ``total`` the words of the corpus. The ways, ten times as large as the counts, are worked out
    where they are first asked for; what is sent to a task is the counts.
    """

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, float(counts.sum())
        smooth = counts + 1.0
        self.order = np.argsort(-smooth, kind="stable")
        self.kind = np.empty(len(counts), np.int64)
        self.kind[self.order[:OWN_CLASSES]] = np.arange(OWN_CLASSES)
        rest = self.order[OWN_CLASSES:]
        upto = np.cumsum(smooth[rest])
        self.kind[rest] = OWN_CLASSES + np.minimum(((upto - smooth[rest]) / upto[-1] * (CLASSES - OWN_CLASSES)).astype(np.int64), CLASSES - OWN_CLASSES - 1)
        total = np.bincount(self.kind, smooth, minlength=CLASSES)
        self.share, self.prior = np.log(smooth / total[self.kind]), np.log(np.maximum(total, 1e-300) / total.sum())

    def __reduce__(self) -> tuple:
        return Words, (self.counts,)

    @cached_property
    def ways(self) -> tuple[np.ndarray, ...]:
        """first, forks, right, odds and spans.

        The forks of word w are ``forks[first[w] : first[w + 1]]``, and ``right`` says which side it is on. ``odds`` of a
        fork are the log odds of its right side in the corpus, its span the places in the order of its first word and after
        its last.
        """
        return _ways(self.order, self.kind[self.order], self.counts[self.order] + 1.0)

    @cached_property
    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forks of each tree class's first ``TOP`` levels, as numbered in a heap (0, which is no fork, where there is none);
        and of every word the number of its forks among them, and its sides there as bits, the first one highest."""
        depth = np.minimum(np.diff(self.first), TOP).astype(np.uint8)
        side, forks = np.zeros(len(depth), np.uint8), np.zeros((CLASSES - OWN_CLASSES, _NODES), np.int64)
        for level in range(TOP):
            there = np.flatnonzero(depth > level)
            at = self.first[there] + level
            forks[self.kind[there] - OWN_CLASSES, (1 << level) - 1 + (side[there] >> (TOP - level))] = self.forks[at]
            side[there] |= self.right[at].astype(np.uint8) << (TOP - 1 - level)
        return forks, depth, side

    first = property(lambda self: self.ways[0])
    forks = property(lambda self: self.ways[1])
    right = property(lambda self: self.ways[2])
    odds = property(lambda self: self.ways[3])
    spans = property(lambda self: self.ways[4])


def words_of(counts: np.ndarray) -> Words:
    return Words(counts)


def _ways(order: np.ndarray, kind: np.ndarray, smooth: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, forks, right, odds and spans of words in order of class: each stretch is cut where half of its weight is reached.

    A fork is named by the place in the order of the first word on its right, which no other fork has.
    """
    upto = np.concatenate(([0.0], np.cumsum(smooth)))
    low, high = (np.searchsorted(kind, kind, side=side).astype(np.int32) for side in ("left", "right"))
    odds, spans = np.zeros(len(order), np.float32), np.zeros((2, len(order)), np.int32)
    depth = np.zeros(len(order), np.int32)
    levels = []
    inside = np.flatnonzero(high - low > 1).astype(np.int32)
    while len(inside):
        a, b = low[inside], high[inside]
        head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))  # a stretch's words lie side by side
        left, end = a[head], b[head]
        cut = np.clip(np.searchsorted(upto, (upto[left] + upto[end]) / 2), left + 1, end - 1).astype(np.int32)
        odds[cut] = np.log((upto[end] - upto[cut]) / (upto[cut] - upto[left]))
        spans[:, cut] = left, end
        cut = np.repeat(cut, np.diff(head, append=len(a)))
        side = inside >= cut
        levels.append((inside, cut, side))
        depth[inside] += 1
        low[inside], high[inside] = np.where(side, cut, a), np.where(side, b, cut)
        inside = inside[high[inside] - low[inside] > 1]
    count = np.zeros(len(order), np.int64)
    count[order] = depth
    first = np.concatenate(([0], np.cumsum(count)))
    start = first[order]
    forks, right = np.empty(first[-1], np.int32), np.empty(first[-1], bool)
    for level, (inside, cut, side) in enumerate(levels):
        at = start[inside] + level
        forks[at], right[at] = cut, side
    return first, forks, right, odds, spans


def start_weights(words: Words) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    weights = {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in _SHAPES.items() if name != "fork"}
    weights["hidden"][:] = 0
    weights["bias"][:] = words.prior
    return weights


def _hashed(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _neighbours(context: np.ndarray, text: np.ndarray, first: int, last: int) -> np.ndarray:
    """Context rows of the words around each position from first to last; the last row stands for the text's edge."""
    found = np.full((len(_PLACES), last - first), _CONTEXT, np.int64)
    for k, place in enumerate(_PLACES):
        low, high = max(first, -place), min(last, len(context) - place)
        if low < high:
            other = slice(low + place, high + place)
            found[k, low - first : high - first] = np.where(text[other] == text[low:high], context[other], _CONTEXT)
    return found


def _forward(weights: dict[str, np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden layer, and scores of the classes, moved row by row so that none is above 0 and not all are far below."""
    total = weights["near"][0].take(near[0], axis=0)
    for k in range(1, len(near)):
        total += weights["near"][k].take(near[k], axis=0)
    total += weights["hidden"]
    hidden = np.tanh(total, out=total)
    score = hidden @ weights["out"]
    # The hidden layer is between -1 and 1: that bounds the largest score without a look at every row.
    reach = np.abs(weights["out"]).sum(axis=0)
    most = (weights["bias"] + reach).max()
    if most - (weights["bias"] - reach).max() < _FAR:
        score += weights["bias"] - most
    else:
        score += weights["bias"]
        score -= score.max(axis=1, keepdims=True)
    return hidden, score


def _soft(x: np.ndarray) -> np.ndarray:
    """log(1 + e^x), to the precision of its type and without overflow."""
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def _levels(words: Words, word: np.ndarray, top: int = 0) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Places of the words by number of forks, most first; and level by level, from ``top`` on, fork and side of those that have so many.

    The words with a fork on a level are the first so many of that order, so a level needs no index of its rows.
    """
    count = words.first[word + 1] - words.first[word]
    by_depth = np.argsort((255 - count).astype(np.uint8), kind="stable")
    way = words.first[word[by_depth]]
    deep = len(word) - np.cumsum(np.bincount(count))[:-1]
    return by_depth, [(words.forks.take(at), words.right.take(at)) for at in (way[:n] + level for level, n in enumerate(deep) if level >= top)]


class _Top:
    """The forks of a batch's words on the first ``TOP`` levels: all of a class's forks are asked for all of its words
    at once, which is one product of two small matrices, and each word keeps the answers on its way.

    ``at`` has the batch's words of tree classes, by class, and ``there``, level by level, which of them have it.
    """

    def __init__(self, words: Words, word: np.ndarray, kind: np.ndarray, hidden: np.ndarray, forks: np.ndarray):
        """``forks``: weights of the classes' forks, by class and number."""
        own = np.bincount(kind, minlength=CLASSES)
        ends = np.cumsum(own[OWN_CLASSES:])
        self.stretches = [(c, slice(end - n, end)) for c, (n, end) in enumerate(zip(own[OWN_CLASSES:].tolist(), ends.tolist(), strict=True)) if n]
        self.at = np.argsort(kind.astype(np.uint8), kind="stable")[len(kind) - ends[-1] :]
        word = word[self.at]
        levels = np.arange(TOP, dtype=np.uint8)[:, None]
        fork_of, depth, side = words.top
        side = side.take(word)
        node = ((1 << levels) - 1).astype(np.uint8) + (side >> (TOP - levels))
        self.there, self.right = depth.take(word) > levels, (side >> (TOP - 1 - levels)) & 1
        self.place = np.arange(len(word)) * _NODES + node
        self.layer, self.forks = hidden.take(self.at, axis=0), forks
        self.scores = np.empty((len(word), _NODES), np.float32)
        for c, some in self.stretches:
            np.matmul(self.layer[some], forks[c].T, out=self.scores[some])
        self.odds = words.odds[fork_of].ravel().take((kind[self.at] - OWN_CLASSES) * _NODES + node) + self.scores.ravel().take(self.place)

    def back(self, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the errors of the words' answers mean to their hidden layer, and to the forks."""
        errors = self.scores
        errors[:] = 0
        errors.reshape(-1)[self.place] = wrong
        layer, forks = np.empty_like(self.layer), np.zeros_like(self.forks)
        for c, some in self.stretches:
            np.matmul(errors[some], self.forks[c], out=layer[some])
            np.matmul(errors[some].T, self.layer[some], out=forks[c])
        return layer, forks


def _order(rows: np.ndarray) -> np.ndarray:
    """Places of the rows in ascending order, equal ones in theirs: by 16 bits at a time, which numpy does in linear time."""
    low = np.argsort(rows.astype(np.uint16), kind="stable")
    high = (rows >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


_SHORT = 8  # rows up to which a sum is made place by place, for all sums at once


def _sums(values: np.ndarray, row: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums over ``values[row]`` from each head to the next."""
    total, by_size = _sums_by_size(values, row, head)
    found = np.empty_like(total)
    found[by_size] = total
    return found


def _sums_by_size(values: np.ndarray, row: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over ``values[row]`` from each head to the next, those of most rows first, and the places of their heads."""
    size = np.diff(head, append=len(row))
    lack = np.maximum(_SHORT + 1 - size, 0).astype(np.uint8)
    by_size = np.argsort(lack, kind="stable")  # those with a next row are the first so many
    upto = np.cumsum(np.bincount(lack, minlength=_SHORT + 1))
    first = head[by_size]
    total = values.take(row[first], axis=0)
    for k in range(1, _SHORT):
        n = upto[_SHORT - k]
        if not n:
            break
        total[:n] += values.take(row[first[:n] + k], axis=0)
    n = upto[0]
    if n:
        left = size[by_size[:n]] - _SHORT
        starts = np.cumsum(left) - left
        at = np.arange(left.sum()) + np.repeat(first[:n] + _SHORT - starts, left)
        total[:n] += np.add.reduceat(values.take(row[at], axis=0), starts, axis=0)
    return total, by_size


class Trainer:
    """AdaGrad on one group's documents; a row of weights has one step size."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {"fork": np.zeros(_SHAPES["fork"], np.float32)} | {k: v.copy() for k, v in weights.items()}
        self.squares = {k: np.full(v.shape if k in ("out", "bias", "hidden") else v.shape[:-1], 1e-2, np.float32) for k, v in self.weights.items()}
        self.learnt = 0
        # Positions that learnt a row of "near", and occurrences of words, of which those of the forks follow.
        self.times = {"near": np.zeros(_SHAPES["near"][:-1], np.int64), "word": np.zeros(1 << WORD_BITS, np.int64)}

    def _step(self, name: str, gradient: np.ndarray) -> None:
        self.squares[name] += gradient**2
        self.weights[name] -= RATE * gradient / np.sqrt(self.squares[name])

    def _step_rows(self, name: str, gradient: np.ndarray, rows: np.ndarray) -> None:
        """A step of the rows named, each by the sum of its gradients. Rows are numbered through all places.

        Of more rows than gradients, every next lot of as many has the same gradients again.
        """
        if len(rows):
            order = _order(rows)
            ordered = rows[order]
            head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            total, by_size = _sums_by_size(gradient, order % len(gradient), head)
            own = ordered[head[by_size]]
            squares = self.squares[name].reshape(-1)
            size = squares.take(own) + np.einsum("ij,ij->i", total, total) / HIDDEN
            squares[own] = size
            total *= (-RATE / np.sqrt(size))[:, None]
            weights = self.weights[name].reshape(-1, HIDDEN)
            total += weights.take(own, axis=0)
            weights[own] = total

    def learn(self, hashes: np.ndarray, text: np.ndarray, words: Words) -> None:
        context, word = _hashed(hashes, CONTEXT_BITS), _hashed(hashes, WORD_BITS)
        kinds = words.kind[word]
        place = (np.arange(len(_PLACES)) * (_CONTEXT + 1))[:, None]
        all_of = np.ones(BATCH, np.float32)
        fork_of = words.top[0]
        forks, squares = self.weights["fork"][fork_of], self.squares["fork"][fork_of]
        for first in range(0, len(hashes), BATCH):
            last = min(first + BATCH, len(hashes))
            kind = kinds[first:last]
            near = _neighbours(context, text, first, last)
            hidden, score = _forward(self.weights, near)
            scale = np.float32((last - first) ** -0.5)
            error = np.exp(score, out=score)
            error *= (scale / (error @ _ONES))[:, None]
            error[np.arange(last - first), kind] -= scale
            inner = error @ self.weights["out"].T
            top = _Top(words, word[first:last], kind, hidden, forks)
            by_depth, levels = _levels(words, word[first:last], TOP)
            if levels:
                deepest = by_depth[: len(levels[0][0])]
                layer, back = hidden.take(deepest, axis=0), np.zeros((len(deepest), HIDDEN), np.float32)
                moves = np.empty((sum(len(fork) for fork, _ in levels), HIDDEN), np.float32)
                done = 0
                for fork, right in levels:
                    n = len(fork)
                    own = self.weights["fork"].take(fork, axis=0)
                    odds = words.odds.take(fork) + np.einsum("ij,ij->i", layer[:n], own)
                    wrong = ((1 / (1 + np.exp(-odds)) - right) * scale)[:, None]
                    np.multiply(layer[:n], wrong, out=moves[done : done + n])
                    own *= wrong
                    back[:n] += own
                    done += n
                inner[deepest] += back
                self._step_rows("fork", moves, np.concatenate([fork for fork, _ in levels]))
            back, moves = top.back((1 / (1 + np.exp(-top.odds)) - top.right) * top.there * scale)
            inner[top.at] += back
            squares += np.einsum("ijk,ijk->ij", moves, moves) / HIDDEN
            moves *= (RATE / np.sqrt(squares))[:, :, None]
            forks -= moves
            inner *= 1 - hidden**2
            self._step("out", hidden.T @ error)
            self._step("bias", all_of[: last - first] @ error)
            self._step("hidden", all_of[: last - first] @ inner)
            self._step_rows("near", inner, (near + place).ravel())
        some = fork_of > 0
        self.weights["fork"][fork_of[some]], self.squares["fork"][fork_of[some]] = forks[some], squares[some]
        for times, near in zip(self.times["near"], _neighbours(context, text, 0, len(hashes)), strict=True):
            times += np.bincount(near, minlength=_CONTEXT + 1)
        self.times["word"] += np.bincount(word, minlength=1 << WORD_BITS)
        self.learnt += len(hashes)


def log_likelihood(texts: list[bytes], words: Words, weights: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the sum of the log-probabilities of each given its neighbours.

    Weights without forks, those before any training, leave a word its share of its class.
    """
    hashes, text = word_hashes(texts)
    context, word = _hashed(hashes, CONTEXT_BITS), _hashed(hashes, WORD_BITS)
    kind, share = words.kind[word], words.share[word]
    total = np.zeros(len(texts))
    forks = weights["fork"][words.top[0]] if "fork" in weights and len(hashes) else None
    for first in range(0, len(hashes), SCORED):
        at = slice(first, min(first + SCORED, len(hashes)))
        hidden, score = _forward(weights, _neighbours(context, text, at.start, at.stop))
        low = text[first]
        inside = share[at].copy()
        if forks is not None:
            top = _Top(words, word[at], kind[at], hidden, forks)
            inside[:] = 0
            inside[top.at] = -(_soft(np.where(top.right, -top.odds, top.odds)) * top.there).sum(axis=0, dtype=np.float64)
            by_depth, levels = _levels(words, word[at], TOP)
            if levels:
                deepest = by_depth[: len(levels[0][0])]
                layer, below = hidden.take(deepest, axis=0), np.zeros(len(deepest))
                for fork, right in levels:
                    n = len(fork)
                    odds = words.odds.take(fork) + np.einsum("ij,ij->i", layer[:n], weights["fork"].take(fork, axis=0))
                    below[:n] -= _soft(np.where(right, -odds, odds))
                inside[deepest] += below
        inside += score[np.arange(len(inside)), kind[at]] - np.log(np.exp(score, out=score) @ _ONES)
        sums = np.bincount(text[at] - low, inside)
        total[low : low + len(sums)] += sums
    return np.bincount(text, minlength=len(texts)), total


def count_words(rows: DataFrame) -> np.ndarray:
    """Occurrences of every hashed word in all texts."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            hashes, _ = word_hashes(as_bytes(batch.column("text")))
            word, n = np.unique(_hashed(hashes, WORD_BITS).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

    got = in_tasks(rows.select("text"), per_batch, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << WORD_BITS)
    counts[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return counts


# Names of what is learnt by all positions alike: one row each of HIDDEN numbers, after those of "near" and "fork".
_TABLES = ("near", "fork")
_WHOLE = ("hidden", "out", "bias")


def _rows_learnt(trainer: Trainer, words: Words) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Table, rows, positions that learnt them and weights, of what a group has learnt.

    A fork has learnt from every occurrence of the words of its span.
    """
    upto = np.concatenate(([0], np.cumsum(trainer.times["word"][words.order])))
    found = []
    for kind, (name, times) in enumerate(zip(_TABLES, (trainer.times["near"].ravel(), upto[words.spans[1]] - upto[words.spans[0]]), strict=True)):
        rows = np.flatnonzero(times)
        found.append((kind, rows, times[rows], trainer.weights[name].reshape(-1, HIDDEN)[rows]))
    whole = np.concatenate([trainer.weights[name].ravel() for name in _WHOLE]).reshape(-1, HIDDEN)
    found.append((len(_TABLES), np.arange(len(whole)), np.full(len(whole), trainer.learnt), whole))
    return found


def _put_rows(weights: dict[str, np.ndarray], learnt: pa.Table) -> None:
    """Put the rows learnt, columns kind, row and their numbers, in place of the weights' own."""
    weights.setdefault("fork", np.zeros(_SHAPES["fork"], np.float32))
    whole = np.concatenate([weights[name].ravel() for name in _WHOLE]).reshape(-1, HIDDEN)
    tables = [*(weights[name].reshape(-1, HIDDEN) for name in _TABLES), whole]
    for batch in learnt.to_batches(max_chunksize=1 << 15):
        kind, row = batch.column("kind").to_numpy(), batch.column("row").to_numpy()
        values = np.stack([batch.column(f"w{i}").to_numpy() for i in range(HIDDEN)], axis=1)
        for k, table in enumerate(tables):
            table[row[kind == k]] = values[kind == k]
    at = 0
    for name in _WHOLE:
        weights[name] = whole.ravel()[at : at + weights[name].size].reshape(_SHAPES[name]).copy()
        at += weights[name].size


def _dealt(rows: DataFrame, groups: int, folder: str) -> DataFrame:
    """Columns group, h, text, times: every text, with how many of its copies the group learns from.

    Rows of a text with more than ``COPIES`` copies are one row for each of several groups: the copies are counted
    where they lie, and the text is sent once.
    """
    hashed = rows.select(filled(F.col("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    several = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COPIES)
    several = stored(several.select("h", F.lit(True).alias("hot")), folder, "copied")
    marked = hashed.join(several, "h", "left")
    once = marked.filter(F.col("hot").isNull()).select(F.pmod("h", F.lit(groups)).cast("int").alias("group"), "h", "text", F.lit(1).cast("long").alias("times"))
    hot = hashed.join(several, "h", "left_semi").groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"))
    parts = F.least(F.ceil(F.col("n") / COPIES), F.lit(groups).cast("long"))
    hot = hot.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    times = F.floor(F.col("n") / F.col("parts")) + F.when(F.col("part") < F.col("n") % F.col("parts"), 1).otherwise(0)
    return once.union(hot.select(F.pmod(F.pmod("h", F.lit(groups)) + F.col("part"), F.lit(groups)).cast("int"), "h", "text", times.cast("long")))


def train(rows: DataFrame, words: Words, folder: str, sent: Broadcast | None = None) -> dict[str, np.ndarray]:
    """Weights learnt from all texts, in rounds. ``sent``: the words, if tasks have them already."""
    weights = start_weights(words)
    known = sent or rows.sparkSession.sparkContext.broadcast(words)
    total = int(round(words.total))
    groups = max(1, -(-total // GROUP_WORDS))
    rounds = min(ROUNDS, groups)
    dealt = _dealt(rows, groups, folder)
    numbers = [f"w{i}" for i in range(HIDDEN)]
    for turn in range(rounds if total else 0):
        given = rows.sparkSession.sparkContext.broadcast(weights)

        def per_task(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            words, weights = known.value, given.value
            own, trainer, held, size, texts = None, None, [], 0, 0

            def learn(last: bool) -> None:
                """From whole chunks of the group's words, and at its end from the rest."""
                nonlocal held, size
                if size >= _CHUNK or last:
                    hashes, text = (np.concatenate([h[i] for h in held] or [np.zeros(0, np.uint64)]) for i in (0, 1))
                    at = 0
                    while len(hashes) - at >= _CHUNK or (last and at < len(hashes)):
                        trainer.learn(hashes[at : at + _CHUNK], text[at : at + _CHUNK], words)
                        at += _CHUNK
                    held, size = [(hashes[at:], text[at:])], len(hashes[at:])

            def told() -> Iterator[pa.RecordBatch]:
                learn(True)
                if trainer.learnt:
                    for kind, row, n, values in _rows_learnt(trainer, words):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), x, np.int32)) for x in (own, kind)]
                            + [pa.array(row.astype(np.int32)), pa.array(n)]
                            + [pa.array(np.ascontiguousarray(values[:, i])) for i in range(HIDDEN)],
                            names=["group", "kind", "row", "n", *numbers],
                        )

            for batch in portions(batches):
                group, times = batch.column("group").to_numpy(), batch.column("times").to_numpy()
                raw = as_bytes(batch.column("text"))
                edges = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
                for first, last in zip(edges, edges[1:], strict=False):
                    if trainer is None or group[first] != own:
                        if trainer is not None:
                            yield from told()
                        own, trainer, held, size, texts = int(group[first]), Trainer(weights), [], 0, 0
                    hashes, text = word_hashes(raw[first:last])
                    edge = np.searchsorted(text, np.arange(last - first + 1))
                    for i in range(last - first):
                        part = hashes[edge[i] : edge[i + 1]]
                        for _ in range(times[first + i]):
                            held.append((part, np.full(len(part), texts, np.int64)))
                            size += len(part)
                            texts += 1
                            if size >= _CHUNK:
                                learn(False)
            if trainer is not None:
                yield from told()

        part = dealt.filter(F.col("group") % rounds == turn).withColumn("slot", F.floor(F.col("group") / rounds).cast("int"))
        part = part.repartitionById(-(-groups // rounds), F.col("slot")).sortWithinPartitions("group", "h", "text").drop("slot")
        schema = "group int, kind int, row int, n long, " + ", ".join(f"{w} float" for w in numbers)
        learnt = in_tasks(part, per_task, schema)
        sums = [F.sum(F.col(w).cast("double") * F.col("n")).alias(w) for w in numbers]
        learnt = learnt.groupBy("kind", "row", F.floor(F.col("group") / FAN_IN).alias("part")).agg(F.sum("n").alias("n"), *sums)
        means = [(F.sum(w) / F.sum("n")).cast("float").alias(w) for w in numbers]
        learnt = stored(learnt.groupBy("kind", "row").agg(*means), folder, f"weights{turn}")
        given.destroy()  # the round's result is a stored table, so nothing asks for these weights again
        _put_rows(weights, learnt.toArrow())
        pa.default_memory_pool().release_unused()
    if sent is None:
        known.destroy()
    return weights


def lm_scores(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its words and their summed conditional log-probability under the corpus's own model.

    Words are runs of ASCII letters (any case), digits and characters beyond ASCII. A text without words, null included,
    scores 0 and has no mean. Repeated rows score alike. An empty table gives an empty result; other columns are not
    read. Columns: file, row, doc_id, n_words, log_likelihood, mean_log_probability.
    """
    folder = shared_folder(spark)
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    words = words_of(count_words(rows))
    known = spark.sparkContext.broadcast(words)
    model = spark.sparkContext.broadcast(train(rows, words, folder, known))
    kind = dict(rows.dtypes)["doc_id"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            n, total = log_likelihood(as_bytes(batch.column("text")), known.value, model.value)
            mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(n.astype(np.int64)), pa.array(total), mean],
                names=["file", "row", "doc_id", "n_words", "log_likelihood", "mean_log_probability"],
            )

    return in_tasks(rows, per_batch, f"file long, row long, doc_id {kind}, n_words long, log_likelihood double, mean_log_probability double")
