"""Token counts through a cache keyed by digests of the text and of the tokenizer.

The cache is a table: digest of the tokenizer file, digest of the text, bytes, tokens. Rows are joined to it by
digest; of the digests it lacks, one row each is encoded and appended, so a text is encoded once however many
copies there are, and never again in later runs with the same tokenizer.

The text is normalised as the counts allow: null is empty, and nothing else may change, for a byte-level
tokenizer counts every byte.

A task encodes by pieces: byte-pair merges never cross the tokenizer's own splits, so the library encodes each
different piece once per task and a text's count is the sum over its pieces. That holds for texts in which every
library agrees on what is a letter, a number or a space (characters below U+0250, no odd controls) and for
tokenizers that split this way; all other texts, and other tokenizers, go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.shared import filled, in_tasks, keyed, only_rows, shared_folder, stored, without_rows
from bazaarlens.llm.words import portions

LIMIT = 512
# Different pieces a task remembers, and bytes of text it splits at a time.
_REMEMBERED = 300_000
_AT_ONCE = 1 << 20
# Fixed value: the split of byte-level tokenizers, as their files name it.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = r"[\t\n\r\x20-\x7e\xa1-ɏ]*"
_SCHEMA = "tokenizer string, digest binary, n_bytes long, n_tokens long"


def _splits_plainly(spec: dict) -> bool:
    """Whether the tokenizer's counts are sums over the pieces of ``_SPLIT``."""
    before = spec.get("pre_tokenizer") or {}
    model = spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and model.get("type", "BPE") == "BPE"
        and not model.get("dropout")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    )


class Counter:
    """Counts tokens of texts as the tokenizers library does, with no special tokens added."""

    def __init__(self, content: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(content)
        self._library = Tokenizer.from_str(content)
        self._library.no_truncation()
        self._library.no_padding()
        self._by_piece = _splits_plainly(spec)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self._added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._split = regex.compile(_SPLIT)
        self._plain = regex.compile(_PLAIN)
        self._known: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _some(self, texts: list[str]) -> list[int]:
        whole = [i for i, t in enumerate(texts) if not (self._by_piece and self._plain.fullmatch(t))]
        counts = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True)) if whole else {}
        pieces: dict[int, list[str]] = {}
        extra: dict[int, int] = {}
        for i, text in enumerate(texts):
            if i not in counts:
                parts = self._added.split(text) if self._added else [text]
                extra[i] = len(parts) - 1
                pieces[i] = [p for part in parts for p in self._split.findall(part)]
        if len(self._known) > _REMEMBERED:
            self._known.clear()
        new = list({p for found in pieces.values() for p in found}.difference(self._known))
        self._known.update(zip(new, self._encode(new), strict=True))
        known = self._known.__getitem__
        return [counts[i] if i in counts else extra[i] + sum(map(known, pieces[i])) for i in range(len(texts))]

    def counts(self, texts: list[str]) -> list[int]:
        found: list[int] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _AT_ONCE:
                found += self._some(group)
                group, size = [], 0
        return found + (self._some(group) if group else [])


def _cached(spark: SparkSession, path: str, version: str) -> DataFrame:
    """What the cache holds for this tokenizer: digest and tokens, each digest once."""
    try:
        table = spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], _SCHEMA)
    return table.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    spark: SparkSession,
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    limit: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: bytes and tokens of its text under the tokenizer file ``tokenizer``.

    ``cache`` is a folder that all executors reach and that later runs use again; by default a new one. Two runs
    that append the same digest do no harm. Null text has no bytes and no tokens. An empty table gives an empty
    result; other columns are not read. Columns: file, row, doc_id, n_bytes, n_tokens, over_limit.
    """
    content = Path(tokenizer).read_text(encoding="utf-8")
    version = hashlib.sha256(content.encode()).hexdigest()
    folder = shared_folder(spark)
    cache = cache or f"{folder}/cache"
    digest = F.unhex(F.sha2(filled(F.col(text)), 256))
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.octet_length(filled(F.col(text))).cast("long").alias("n_bytes"))
    rows = stored(rows, folder, "rows")
    misses = rows.groupBy("digest").agg(F.min(F.struct("file", "row")).alias("one")).join(_cached(spark, cache, version), "digest", "left_anti")
    misses = stored(misses.select("one.*"), folder, "misses")
    n_rows, n_misses = rows.count(), misses.count()
    if n_misses:
        # The shorter of two lists: the rows to encode or the rows to leave; a short one spares the texts a shuffle.
        if 2 * n_misses > n_rows:
            left = stored(rows.select("file", "row").join(misses, ["file", "row"], "left_anti"), folder, "left")
            texts = without_rows(docs, left)
        else:
            texts = only_rows(docs, misses)
        texts = texts.select(digest.alias("digest"), filled(F.col(text)).alias("text"))
        tokenizer_file = spark.sparkContext.broadcast(content)  # one file

        def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = None
            for batch in portions(batches):
                counter = counter or Counter(tokenizer_file.value)
                found = [t or "" for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([version] * len(found), pa.string()),
                        batch.column("digest"),
                        pa.array([len(t.encode()) for t in found], pa.int64()),
                        pa.array(counter.counts(found), pa.int64()),
                    ],
                    names=["tokenizer", "digest", "n_bytes", "n_tokens"],
                )

        in_tasks(texts, per_task, _SCHEMA).write.mode("append").parquet(cache)
    # A table of its own, so that both sides of the join come straight from a shuffle and a hot digest is split.
    wanted = rows.select("digest").distinct()
    counts = stored(_cached(spark, cache, version).join(wanted, "digest", "left_semi"), folder, "counts")
    counted = rows.join(counts, "digest")
    return counted.select("file", "row", "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
