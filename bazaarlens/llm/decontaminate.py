"""Benchmark passages in documents, found by binary search in suffix arrays of the documents.

The documents are the indexed side. A shard (the documents of one Arrow batch) gets a suffix array over its
words: the places where at least one window of words that occur in the test items starts, sorted by the words
that follow. Places inside shorter runs of such words cannot start a match, so leaving them out is exact.
Every suffix of every test item is then looked up in every shard by binary search on its first ``WINDOW`` words;
the range found holds all its occurrences, and occurrences that continue each other along an item are joined
to the longest verbatim match, with its place in the document and in the item. Words are compared by 64-bit
hashes, then every matched word byte by byte.

Test items reach the tasks in blocks of at most ``BLOCK_BYTES`` of text (or one item), so what is collected and
broadcast is bounded whatever the size of the benchmark. Texts are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, in_tasks, keyed, row_key, shared_folder, stored, without_rows
from bazaarlens.llm.words import LETTERS, as_bytes, portions, word_hashes

WINDOW = 10
BLOCK_BYTES = 16 << 20
# The same words as ``LETTERS`` over lower-cased bytes, for the byte-by-byte comparison.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MATCH = "array<struct<item:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


@dataclass
class TestItems:
    """A block of test items: their words as numbers from 1 on, and their windows."""

    ids: list[str | None]
    vocabulary: np.ndarray  # sorted hashes; the word of hash k has number k + 1
    spelling: list[bytes]
    suffixes: np.ndarray  # of each window the words' numbers, 0 where the window is shorter
    lengths: np.ndarray  # words of each window
    first: np.ndarray  # places of window k: places[first[k]:first[k + 1]]
    places: np.ndarray  # (item, word) rows


def test_items(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> TestItems:
    """Items without a word have no window."""
    texts = [(t or "").encode() for _, t in rows]
    hashes, number = word_hashes(texts)
    vocabulary, at = np.unique(hashes, return_index=True)
    words = [w for t in texts for w in _WORD.findall(t.lower())]
    ids = np.searchsorted(vocabulary, hashes).astype(np.int64) + 1
    count = np.bincount(number, minlength=len(rows))
    begin = np.cumsum(count) - count
    places = [(i, j) for i, n in enumerate(count) for j in range(max(1, n - window + 1) if n else 0)]
    grid = np.zeros((len(places), window), np.int64)
    lengths = np.zeros(len(places), np.int64)
    for k, (i, j) in enumerate(places):
        part = ids[begin[i] + j : begin[i] + min(count[i], j + window)]
        grid[k, : len(part)], lengths[k] = part, len(part)
    suffixes, group = np.unique(grid, axis=0, return_inverse=True) if places else (grid, np.zeros(0, np.int64))
    order = np.argsort(group, kind="stable")
    first = np.searchsorted(group[order], np.arange(len(suffixes) + 1))
    where = np.array(places, np.int64).reshape(-1, 2)[order]
    return TestItems([r[0] for r in rows], vocabulary, [words[i] for i in at], suffixes, (suffixes > 0).sum(axis=1), first, where)


def _packed(words: np.ndarray, bits: int) -> np.ndarray:
    """Rows of word numbers as rows of fewer longs in the same order."""
    each = 62 // bits
    columns = []
    for at in range(0, words.shape[1], each):
        key = np.zeros(len(words), np.int64)
        for k in range(at, min(at + each, words.shape[1])):
            key = (key << bits) | words[:, k]
        columns.append(key)
    return np.stack(columns, axis=1)


def _bound(table: np.ndarray, wanted: np.ndarray, above: bool) -> np.ndarray:
    """For each wanted row, how many rows of the sorted table are below it (or, ``above``, not above it)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(table), np.int64)
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        row = table[np.minimum(middle, len(table) - 1)]
        less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for k in range(table.shape[1]):
            less |= equal & (row[:, k] < wanted[:, k])
            equal &= row[:, k] == wanted[:, k]
        right = open_ & (less | (equal if above else False))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def _occurrences(ids: np.ndarray, text: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (window, place): every occurrence of every window in the words of a shard."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(items.suffixes):
        return none, none
    depth = items.suffixes.shape[1]
    stop = np.append((ids[:-1] == 0) | (text[:-1] != text[1:]), True)  # no run goes past this word
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, np.arange(len(ids)))]
    run = np.where(ids > 0, last - np.arange(len(ids)) + (ids[last] > 0), 0)
    place = np.flatnonzero(run >= items.lengths.min())
    if not len(place):
        return none, none
    words = np.zeros((len(place), depth), np.int64)
    for k in range(depth):
        inside = run[place] > k
        words[inside, k] = ids[place[inside] + k]
    bits = int(len(items.vocabulary) + 1).bit_length()
    keys = _packed(words, bits)
    order = np.lexsort(keys.T[::-1])  # the suffix array
    table, place = keys[order], place[order]
    low = _bound(table, _packed(items.suffixes, bits), above=False)
    high = _bound(table, _packed(np.where(items.suffixes > 0, items.suffixes, (1 << bits) - 1), bits), above=True)
    found = high - low
    window = np.repeat(np.arange(len(found)), found)
    inside = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    return window, place[np.repeat(low, found) + inside]


def _longest(window: np.ndarray, place: np.ndarray, text: np.ndarray, items: TestItems, depth: int) -> np.ndarray:
    """Rows (text, item, place, word of the item, words): occurrences joined where they continue each other."""
    each = (items.first[1:] - items.first[:-1])[window]
    occurrence = np.repeat(np.arange(len(window)), each)
    inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    item, word = items.places[items.first[window[occurrence]] + inside].T
    at, length = place[occurrence], items.lengths[window[occurrence]]
    order = np.lexsort((at, at - word, item, text[at]))
    item, word, at, length = item[order], word[order], at[order], length[order]
    new = np.ones(len(at), bool)
    new[1:] = ~(
        (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (word[1:] == word[:-1] + 1)
        & (length[1:] == depth) & (text[at[1:]] == text[at[:-1]])
    )
    head = np.flatnonzero(new)
    extra = np.diff(np.append(head, len(at))) - 1
    return np.stack((text[at[head]], item[head], at[head], word[head], length[head] + extra), axis=1)


def matches(texts: list[bytes], items: TestItems, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, words hit of each text, and the longest matches (places count from the text's start)."""
    hashes, text = word_hashes(texts)
    ids = np.searchsorted(items.vocabulary, hashes).astype(np.int64)
    known = np.zeros(len(hashes), bool)
    near = ids < len(items.vocabulary)
    known[near] = items.vocabulary[ids[near]] == hashes[near]
    ids = np.where(known, ids + 1, 0)
    n_words = np.bincount(text, minlength=len(texts))
    begin = np.cumsum(n_words) - n_words
    while True:
        found, place = _occurrences(ids, text, items)
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + items.lengths[found], -1)
        hit = np.cumsum(mark[:-1]) > 0
        wrong = []
        for i in np.unique(text[hit]):
            words = _WORD.findall(texts[i].lower())
            for p in begin[i] + np.flatnonzero(hit[begin[i] : begin[i] + n_words[i]]):
                if items.spelling[ids[p] - 1] != words[p - begin[i]]:
                    wrong.append(p)
        if not wrong:
            break
        ids[wrong] = 0
    joined = _longest(found, place, text, items, window)
    joined[:, 2] -= begin[joined[:, 0]] if len(joined) else 0
    return n_words, np.bincount(text[hit], minlength=len(texts)), joined


def _against(rows: DataFrame, items: TestItems, window: int) -> DataFrame:
    block = rows.sparkSession.sparkContext.broadcast(items)
    kind = dict(rows.dtypes)["doc_id"]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in portions(batches):
            n_words, n_hit, found = matches(as_bytes(batch.column("text")), items, window)
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for text, item, place, word, length in found.tolist():
                lists[text].append({"item": items.ids[item], "doc_word": place, "item_word": word, "n_words": length})
            match = pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(lists, pa.list_(match))],
                names=["file", "row", "doc_id", "n_words", "n_hit", "matches"],
            )

    return in_tasks(rows, per_batch, f"file long, row long, doc_id {kind}, n_words long, n_hit long, matches {_MATCH}")


def _united(blocks: list[DataFrame], kind: str) -> DataFrame:
    """The results of several blocks as one: a word hit by items of two blocks counts once."""
    every = blocks[0]
    for block in blocks[1:]:
        every = every.union(block)
    spans = "array_sort(transform(matches, m -> struct(m.doc_word AS s, m.doc_word + m.n_words AS e)))"
    covered = (
        f"aggregate({spans}, struct(0L AS n, 0L AS upto), "
        "(a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.upto)) AS n, greatest(a.upto, x.e) AS upto), a -> a.n)"
    )
    grouped = every.groupBy("file", "row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches")
    )
    return grouped.select("file", "row", "doc_id", "n_words", F.expr(covered).alias("n_hit"), "matches")


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: which of its words lie in a passage of the benchmark, and the passages.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A passage is ``window``
    words of an item, or all of an item with fewer; items without words match nothing. Null texts have no words.
    Items that share an id, and repeated items, count once; the passages of an item without an id are hit but not
    listed by id. An empty benchmark or an empty table of documents is no error: nothing is hit, or nothing returned.
    Other columns are not read. Columns: file, row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    longest (words of the longest match) and matches (item, doc_word, item_word, n_words; places from 0).
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), filled(F.col(item_text)).alias("text"), *(k.alias(n) for k, n in zip(row_key(benchmark), ("file", "row"), strict=True)))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    results = []
    for k in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("file", "row"), F.lit(n_blocks)) == k)
        results.append(_against(rows, test_items([(r.id, r.text) for r in part.select("id", "text").collect()], window), window))
    found = results[0] if n_blocks == 1 else _united(results, dict(rows.dtypes)["doc_id"])
    ids = F.array_sort(F.array_distinct(F.array_compact(F.col("matches.item"))))
    return found.select(
        "file",
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max("matches.n_words"), F.lit(0).cast("long")).alias("longest"),
        "matches",
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark.

    Texts without words, null ones included, hold none and stay; equal texts are judged alike. Without a benchmark
    every row stays. An empty table stays empty; all columns pass as they are, whatever their names.
    """
    dropped = decontaminate(spark, docs, benchmark).filter("contaminated").select("file", "row")
    return without_rows(docs, stored(dropped, shared_folder(spark), "dropped"))
