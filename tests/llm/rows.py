"""Documents with everything that can be odd about them, and the same as plain rows."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, file string, row string, kept string, "
    "copies string, rank string, taken string, `_found` string, `odd name` string"
)
# Columns of ours that documents may have as well.
_CLASH = ("f", "r", "k", "c", "a", "t", "x", "o")
WORDS = "the of and a cat sat on mat with über señor 12 x9 Zeta THE Of".split()


def odd_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", " ", "\t\n \x0b\x0c\r", "one", "ONE", "one  two", "one\ttwo", "two words", "日本 語 ☃", "x" * 3000]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    texts.append(" ".join(rng.choice(WORDS) for _ in range(40_000)))
    texts += [texts[12]] * 20 + [texts[13].replace(" ", "\n\n")] * 3
    ids = [*range(len(texts) - 6), None, None, 3, 3, 5, None]
    rows = [
        (i, t, rng.choice(["en", None]), rng.choice(["a", "b", "z", "é", None]), None if t is None else len(t), *_CLASH)
        for i, t in zip(ids, texts, strict=True)
    ]
    rows += rows[14:18]  # whole rows repeated
    rng.shuffle(rows)
    return rows


def frame(spark, rows, tmp_path=None, parts: int = 5):
    """The rows in memory, or as a stored table of several files."""
    df = spark.createDataFrame(rows, SCHEMA)
    if tmp_path is None:
        return df
    df.repartition(parts).write.parquet(str(tmp_path / "docs"))
    return spark.read.schema(df.schema).parquet(str(tmp_path / "docs"))
