"""Phrase collocations by dynamic itemset counting.

The texts are dealt to ``SHARDS`` shards by row, and encoded once: every word as a 64-bit number, every end of a piece
as zero. Steps then scan the shards in turn, round and round, and count phrases of all lengths at the same time.
Single words are counted from step 0. A longer phrase becomes active in the step after both its subphrases (without
the last, without the first word) have reached the threshold, wherever in the cycle that is, and is counted for one
full cycle from there. The steps end when no phrase is active.

In a step the tasks must know which phrases are active. They get two bit tables of bounded size: subphrases that have
reached the threshold, and those that did so within the last cycle; an occurrence is counted if both its subphrases
are in the first and one is in the second. Both tables have one size in all steps, so a bit once set stays set, and
whatever set it, a phrase is counted for a full cycle from the step after its subphrases' bits were. What leaves a task
is a longer phrase's 64-bit number and a count. Bits or numbers shared by chance can only add phrases or raise counts;
none that has the threshold is missed. So a last scan counts the longer phrases found once more, told apart by all
their words, which makes the counts exact.

Numbers of words are hashes. At the end the words of all candidates are looked up in the texts again; if two words that
share a number are found there, both get other numbers and everything is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.llm.shared import in_tasks, keyed, shared_folder, stored
from bazaarlens.llm.words import LOWER, as_bytes, byte_class, mixed, portions, runs, slices
from bazaarlens.session import remove_dir

THRESHOLD, LONGEST, KEPT, SHARDS = 100, 5, 2000, 3
NO_LANG = "und"
# Bits of a table: 32 for each entry it is made for, within these bounds (8 KB to 32 MB).
_BITS = 1 << 16, 1 << 28
_EACH = 32
_OTHER = 28  # a table has no more than 2^28 bits, so a number without its last 28 is another to it
_LOT = 1 << 19  # words counted at once
_SCANNED = 1 << 25  # words a task of the last scan reads, if that makes more than two tasks for each core
_HELD = 1 << 19  # phrases a task holds before it adds up and, if that helps little, hands on their counts
_ROW = 128  # words stored in a row, and up to the end of a piece
_BREAK = 2
_CLASSES = byte_class((0x00, 0xFF)) + byte_class((0x0A, 0x0D), *((c, c) for c in b".,;:!?"))
_CLASSES[[0x20, 0x09]] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_numbers(texts: list[bytes], special: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice of the texts: buffer, start, end, text number and number of each word and (zero) break."""
    taken = {int(x) for x in special}
    for parts in slices(texts, _CLASSES):
        raw, start, end, kind, text, found = runs(parts, _CLASSES)
        found = np.maximum(found, np.uint64(1))
        for i in np.flatnonzero(np.isin(found, special)) if taken else ():
            seed, own = 11, int(found[i])
            while own in taken:
                own = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes().lower(), seed) | 1
                seed += 1
            found[i] = own
        found[kind == _BREAK] = 0
        yield raw, start, end, text, found


def _binary(raw: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def encode(docs: DataFrame, text: str, lang: str, shards: int, special: np.ndarray) -> DataFrame:
    """Columns lang, shard, n, words: word numbers of the texts, those of a language and shard together."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(1, np.uint64)
        for batch in portions(batches):
            langs, shard = batch.column("lang").to_pylist(), batch.column("shard").to_pylist()
            held: dict[tuple[str, int], list[np.ndarray]] = {}
            for *_, number, found in _word_numbers(as_bytes(batch.column("text")), special):
                edge = np.flatnonzero(np.diff(number)) + 1
                for a, b in zip((0, *edge), (*edge, len(number)), strict=True):
                    if a < b:
                        of = held.setdefault((langs[number[a]], shard[number[a]]), [])
                        if not of or of[-1][0] != number[a]:
                            of.append((number[a], []))
                        of[-1][1].append(found[a:b])
            for (lang, s), texts in held.items():
                words = np.concatenate([x for _, of in texts for x in (*of, zero)])
                # A row ends at the first end of a piece after _ROW words, so batches of rows are small.
                breaks = np.flatnonzero(words == 0) + 1
                cuts = np.unique(breaks[np.searchsorted(breaks, np.arange(_ROW, len(words) + 1, _ROW))])
                cuts = np.unique(np.concatenate(([0], cuts, [len(words)])))
                n = np.add.reduceat(words > 0, cuts[:-1], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), s, np.int32)), pa.array(n), _binary(words.tobytes(), cuts * 8)],
                    names=["lang", "shard", "n", "words"],
                )

    key = F.col("file"), F.col("row")
    rows = keyed(docs, F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.select("lang", "text", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int").alias("shard"))
    return in_tasks(rows, per_batch, "lang string, shard int, n long, words binary")


def _lang_number(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 5))


def _joined(sofar: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed((sofar ^ word) * _STEP)


def _named(number: np.ndarray, length: int) -> np.ndarray:
    """A phrase's number with its length in the upper three bits."""
    return (number >> np.uint64(3)) | np.uint64(length << 61)


def _in(table: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which numbers have their bit set."""
    at = number & np.uint64(len(table) * 64 - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def phrases_of(words: np.ndarray, lang: str, longest: int, reached: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: places of the phrases whose subphrases are all in the table ``reached``, their numbers, those of all places before."""
    at = np.flatnonzero(words)
    number = np.zeros(len(words) + 1, np.uint64)
    number[at] = _joined(_lang_number(lang), words[at])
    yield 1, at, _named(number[at], 1), number
    for length in range(2, longest + 1):
        known = np.zeros(len(words) + 1, bool)
        known[at] = _in(reached, _named(number[at], length - 1))
        at = np.flatnonzero(known[:-1] & known[1:])
        longer = np.zeros(len(words) + 1, np.uint64)
        longer[at] = _joined(number[at], words[at + length - 1])
        yield length, at, _named(longer[at], length), number
        number = longer


def count_active(words: np.ndarray, lang: str, longest: int, reached: np.ndarray, recent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and counts of the active phrases of two and more words: what the bits alone say, of every length."""
    for length, at, number, subs in phrases_of(words, lang, longest, reached):
        if length > 1 and len(at):
            head, tail = (_in(recent, _named(subs[x], length - 1)) for x in (at, at + 1))
            yield np.unique(number[head | tail], return_counts=True)


def _lots(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Language and words of the encoded texts, some ``_LOT`` words at a time. Rows end with a break."""
    size = pc.binary_length(batch.column("words")).to_numpy() // 8
    upto = np.concatenate(([0], np.cumsum(size)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + _LOT)))
        rows = batch.slice(first, min(last, batch.num_rows) - first)
        of = rows.column("lang").dictionary_encode()
        code = np.asarray(of.indices)
        column = rows.column("words")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        words = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u8")
        if len(of.dictionary) == 1:
            yield of.dictionary[0].as_py(), words
        else:
            each = np.repeat(code, size[first : first + len(code)])
            for k, lang in enumerate(of.dictionary.to_pylist()):
                yield lang, words[each == k]
        first += len(code)


def _tables(state: DataFrame, step: int, count: int, longest: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the phrases that have reached the threshold, at all and in the last cycle, both made for ``room`` entries.

    Built by the tasks; their size is bounded whatever the number of phrases.
    """
    known = state.filter(F.col("reached").isNotNull() & (F.shiftrightunsigned("number", 61) < longest))
    return _table(known, room), _table(known.filter(F.col("reached") >= step - count), room)


def _table(phrases: DataFrame, count: int) -> np.ndarray:
    bits = _BITS[0]
    while bits < min(count * _EACH, _BITS[1]):
        bits *= 2
    table = np.zeros(bits // 64, np.uint64)
    if count:
        at = F.col("number").bitwiseAND(F.lit(bits - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
        got = phrases.groupBy(F.shiftright(at, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toArrow()
        table[got.column("place").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def _single_counts(shard: DataFrame) -> DataFrame:
    """Columns lang, w, number, n: the words of a shard."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in _lots(batch):
                w, n = np.unique(words[words > 0], return_counts=True)
                number = _named(_joined(_lang_number(lang), w), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(w), pa.string()), pa.array(w.view(np.int64)), pa.array(number.view(np.int64)), pa.array(n)], names=["lang", "w", "number", "n"]
                )

    return in_tasks(shard.select("lang", "words"), per_batch, "lang string, w long, number long, n long")


def _longer_counts(shard: DataFrame, longest: int, tables: Broadcast) -> DataFrame:
    """Columns number, n: the active phrases of two and more words in a shard."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in _lots(batch):
                for number, n in count_active(words, lang, longest, *tables.value):
                    yield pa.RecordBatch.from_arrays([pa.array(number.view(np.int64)), pa.array(n)], names=["number", "n"])

    return in_tasks(shard.select("lang", "words"), per_batch, "number long, n long")


def _added(state: DataFrame, new: DataFrame, keys: list[str], step: int, threshold: int, count: int) -> DataFrame:
    """The state after a step. What has not reached the threshold in a full cycle leaves it."""
    new = new.select(*keys, "n", F.lit(step).alias("start"), F.lit(None).cast("int").alias("reached"))
    total = state.union(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.min("reached").alias("reached"))
    total = total.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= threshold, F.lit(step))))
    return total.filter(F.col("reached").isNotNull() | (F.col("start") + count - 1 > step))


def frequent_phrases(shards: DataFrame, folder: str, threshold: int = THRESHOLD, longest: int = LONGEST, count: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The counting steps. Returns (lang, w, number, n) of words and (number, n) of longer phrases with the threshold.

    A phrase that reached it in step r lets longer ones start at r + 1, and be counted in ``count`` steps. The words'
    counts are exact. No longer phrase that has the threshold is left out; numbers let through by chance may be added, or
    their counts be too high.
    """
    spark = shards.sparkSession
    # Of each length at most so many phrases have the threshold; texts have far fewer, so a quarter of it is room enough.
    words = shards.agg(F.sum("n")).first()[0] or 0
    room = max(1, (longest - 1) * words // threshold // 4)
    singles = spark.createDataFrame([], "lang string, w long, number long, n long, start int, reached int")
    longer = spark.createDataFrame([], "number long, n long, start int, reached int")
    step = 0
    while True:
        known = singles.select(longer.columns).union(longer)
        reached, recent = _tables(known, step, count, longest, room)
        active = recent.any()
        if step >= count and not active:
            done = F.col("reached").isNotNull()
            return singles.filter(done).select("lang", "w", "number", "n"), longer.filter(done).select("number", "n")
        shard = shards.filter(F.col("shard") == step % count)
        if step < count:
            new = _added(singles, _single_counts(shard), ["lang", "w", "number"], step, threshold, count)
            singles = stored(new, folder, f"singles{step}")
        if active:
            given = spark.sparkContext.broadcast((reached, recent))
            new = _added(longer, _longer_counts(shard, longest, given), ["number"], step, threshold, count)
            longer = stored(new, folder, f"longer{step}")
            given.unpersist()
        if 0 < step < count:
            remove_dir(spark, f"{folder}/singles{step - 1}")
        if active:
            remove_dir(spark, f"{folder}/longer{step - 1}")
        step += 1


def _groups(number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the numbers, where each group of equal ones starts in it, and the group of each place in it."""
    order = np.argsort(number)
    ordered = number[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(number)]
    return order, np.flatnonzero(head), np.cumsum(head) - 1


def _same(words: np.ndarray, at: np.ndarray, number: np.ndarray, length: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Place of one occurrence of each phrase that starts at one of the places, and how often it occurs: once or ``times`` a place."""
    order, head, group = _groups(number)
    at = at[order]
    first = at[head]
    told = all((words[at + k] == words[first + k][group]).all() for k in range(length))
    if not told:
        lines = np.stack([words[at + k] for k in range(length)], axis=1)  # phrases of one number: compare whole
        _, head, group = np.unique(lines, axis=0, return_index=True, return_inverse=True)
        first, group = at[head], group.reshape(-1)
    if times is None:
        return first, np.bincount(group)
    n = np.zeros(len(first), np.int64)
    np.add.at(n, group, times[order])
    return first, n


class _Held:
    """Phrases a task has counted, by language and length: numbers, words one after another, and counts."""

    def __init__(self) -> None:
        self.parts: dict[tuple[str, int], list[tuple[np.ndarray, ...]]] = {}
        self.rows = 0

    def add(self, lang: str, length: int, number: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        self.parts.setdefault((lang, length), []).append((number, words, n))
        self.rows += len(n)

    def add_up(self) -> None:
        """One entry for each phrase."""
        for (_, length), parts in self.parts.items():
            if len(parts) > 1:
                number, words, times = (np.concatenate(x) for x in zip(*parts, strict=True))
                first, n = _same(words, np.arange(len(number)) * length, number, length, times)
                parts[:] = [(number[first // length], words[first[:, None] + np.arange(length)].ravel(), n)]
        self.rows = sum(len(n) for parts in self.parts.values() for *_, n in parts)

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        for (lang, length), parts in self.parts.items():
            for _, words, n in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), _written(words, np.arange(len(n)) * length, length), pa.array(n)], names=["lang", "p", "n"]
                )
        self.parts, self.rows = {}, 0


def _written(words: np.ndarray, first: np.ndarray, length: int) -> pa.Array:
    """The numbers of the phrases' words, 8 bytes each, highest first."""
    return _binary(words[first[:, None] + np.arange(length)].astype(">u8").tobytes(), np.arange(len(first) + 1) * (8 * length))


def exact_counts(shards: DataFrame, singles: DataFrame, longer: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST) -> DataFrame:
    """Columns lang, p, n: the words, and the longer phrases with these numbers, told apart by all their words, that occur so often.

    Every task gives a row for each frequent phrase it meets, so there are few tasks, whose number does not follow that
    of the files. Rare phrases let through by a chance bit would be as many rows again: a second table, of other bits of
    the numbers, keeps nearly all of them back.
    """
    context = shards.sparkSession.sparkContext
    numbers = singles.select("number").union(longer.select("number"))
    count = numbers.count()
    others = numbers.select(F.shiftrightunsigned("number", _OTHER).alias("number"))
    table = context.broadcast((_table(numbers, count), _table(others, count)))
    tasks = max(2 * context.defaultParallelism, (shards.agg(F.sum("n")).first()[0] or 0) // _SCANNED)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (one, other) = _Held(), table.value
        for batch in batches:
            for lang, words in _lots(batch):
                for length, at, number, _ in phrases_of(words, lang, longest, one):
                    wanted = _in(one, number) & _in(other, number >> np.uint64(_OTHER))
                    if length > 1 and wanted.any():
                        first, n = _same(words, at[wanted], number[wanted], length)
                        place = np.searchsorted(at, first)
                        held.add(lang, length, number[place], words[first[:, None] + np.arange(length)].ravel(), n)
            if held.rows > _HELD:
                held.add_up()
                if held.rows > _HELD // 2:
                    yield from held.handed_on()
        held.add_up()
        yield from held.handed_on()

    rows = in_tasks(shards.select("lang", "words").coalesce(tasks), per_task, "lang string, p binary, n long")
    found = rows.groupBy("lang", "p").agg(F.sum("n").alias("n")).filter(F.col("n") >= threshold)
    return found.union(singles.select("lang", F.unhex(F.lpad(F.hex("w"), 16, "0")).alias("p"), "n"))


def _unlike(raw: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which words differ in their lower-cased bytes from the word of the same length that starts at ``other``."""
    differs = np.zeros(len(start), bool)
    open_ = np.flatnonzero(start != other)
    for k in range(64):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        differs[open_] |= LOWER[raw[start[open_] + k]] != LOWER[raw[other[open_] + k]]
    for i in open_:
        a, b = (LOWER[raw[x : x + size[i]]] for x in (start[i], other[i]))
        differs[i] |= bool((a != b).any())
    return differs


def _texts_of(docs: DataFrame, text: str, numbers: DataFrame, special: np.ndarray) -> DataFrame:
    """Columns w, word, for the words of the texts that have one of the ``numbers`` (column w)."""
    table = docs.sparkSession.sparkContext.broadcast(_table(numbers.select(F.col("w").alias("number")), numbers.count()))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, set[bytes]] = {}

        def rows(told: dict[int, set[bytes]]) -> pa.RecordBatch:
            pairs = [(h, w) for h, ws in told.items() for w in ws]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array([h for h, _ in pairs], np.uint64).view(np.int64)), pa.array([w.decode("utf-8", "replace") for _, w in pairs], pa.string())], names=["w", "word"]
            )

        for batch in portions(batches):
            for raw, start, end, _, found in _word_numbers(as_bytes(batch.column("text")), special):
                at = np.flatnonzero((found > 0) & _in(table.value, found))
                order, head, group = _groups(found[at])
                at = at[order]
                like = at[head][group]
                size = end[at] - start[at]
                # One number is one word, so one length and the same bytes; what is not so is told as well.
                odd = size != end[like] - start[like]
                odd[~odd] = _unlike(raw, start[at[~odd]], size[~odd], start[like[~odd]])
                for i in (*at[head], *at[odd]):
                    told.setdefault(int(found[i]), set()).add(raw[start[i] : end[i]].tobytes().lower())
            if len(told) > 1 << 17:
                yield rows(told)
                told = {}
        if told:
            yield rows(told)

    texts = docs.select(F.col(text).cast("string").alias("text"))
    return in_tasks(texts, per_task, "w long, word string").distinct().join(numbers, "w", "left_semi")


def _scored(counts: DataFrame, n: DataFrame) -> DataFrame:
    """Columns lang, p, a, l, r, n, score of every candidate, by its weakest cut."""
    size = (F.octet_length("p") / 8).cast("int")
    cuts = counts.filter(F.octet_length("p") > 8).select("lang", "p", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring(p, 1, 8 * k)"), "tail": F.expr("substring(p, 8 * k + 1)")})
    part = lambda name, as_: counts.select("lang", F.col("p").alias(name), F.col("n").alias(as_))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(n, "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "l", "r", "n")}
    over, under = F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"]), wide["l"] * wide["r"]
    cuts = cuts.withColumn("score", F.call_function("div", over, under))
    weakest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "p", "a", "n").agg(weakest).select("lang", "p", "a", "cut.l", "cut.r", "n", "cut.score")


def _contained(counts: DataFrame, longest: int) -> DataFrame:
    """Columns lang, p, within: the most occurrences of any longer candidate around each phrase."""
    longer = counts.filter(F.octet_length("p") > 16)
    places = [(skip, length) for length in range(2, longest) for skip in range(longest - length + 1)]
    inner = F.array(
        *(
            F.when(F.octet_length("p") >= 8 * (skip + length), F.expr(f"substring(p, {8 * skip + 1}, {8 * length})"))
            for skip, length in places
        )
    )
    rows = longer.select("lang", F.col("p").alias("whole"), F.col("n").alias("within"), F.explode(inner).alias("p"))
    rows = rows.filter(F.col("p").isNotNull() & (F.octet_length("p") < F.octet_length("whole")))
    return rows.groupBy("lang", "p").agg(F.max("within").alias("within"))


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    kept: int = KEPT,
    shards: int = SHARDS,
) -> DataFrame:
    """The phrases of each language whose parts occur together most above chance.

    Texts, with A-Z in lower case, are split at ``.,;:!?`` and line breaks into pieces, and these at spaces and tabs into
    words. Null and empty texts have none; a null language is ``und``, together with one of that name. Candidates are
    phrases of 2 to ``longest`` words inside pieces that occur ``threshold`` times or more, overlaps and repeated rows
    included. A phrase cut after k words scores 1000 * a * n / (l * r), rounded down, from the counts of phrase, words of
    the language, and both parts; the lowest score counts, of equal ones the smallest k. Candidates inside a longer
    candidate that occurs as often are dropped. Of each language the first ``kept`` by score and count descending, phrase
    ascending in byte order, which leaves no ties. An empty table gives an empty result; other columns are not read.
    Columns: lang, rank, phrase, a, l, r, n, score.
    """
    special = np.zeros(0, np.uint64)
    while True:
        folder = shared_folder(spark)
        path = f"{folder}/shards"
        encode(docs, text, lang, shards, special).write.partitionBy("shard").parquet(path)
        encoded = spark.read.schema("lang string, n long, words binary, shard int").parquet(path)
        n = encoded.groupBy("lang").agg(F.sum("n").alias("n"))
        singles, longer = frequent_phrases(encoded, folder, threshold, longest, shards)
        counts = stored(exact_counts(encoded, singles, longer, threshold, longest), folder, "counts")
        scored = _scored(counts, stored(n, folder, "words"))
        scored = scored.join(_contained(counts, longest), ["lang", "p"], "left").filter(F.col("within").isNull() | (F.col("within") < F.col("a")))
        scored = stored(scored.drop("within"), folder, "scored")
        places = scored.select("lang", "p", F.explode(F.expr("sequence(1, int(octet_length(p) / 8))")).alias("k"))
        places = places.withColumn("w", F.conv(F.hex(F.expr("substring(p, 8 * k - 7, 8)")), 16, -10).cast("long"))
        words = stored(_texts_of(docs, text, places.select("w").distinct(), special), folder, "texts")
        shared = words.groupBy("w").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("w").collect()
        if not shared:
            break
        special = np.concatenate((special, np.array([r["w"] for r in shared], np.int64).view(np.uint64)))
    phrase = places.join(words, "w").groupBy("lang", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = scored.join(phrase, ["lang", "p"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
