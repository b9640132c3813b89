"""Splitting texts into words inside a task: whole batches at once with numpy, on UTF-8 bytes.

A word is a run of bytes of one class. Classes are tables of 256 entries; all bytes of characters beyond
ASCII have one class, so runs never cut a character. Each word gets a 64-bit hash of its lower-cased bytes:
a polynomial over random byte values, read off two running sums, so the cost per byte is a few
vector operations. Words over 512 bytes, for which such polynomials can be made to collide, are hashed by
XXH64 instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

# Bytes split at once; what a task holds beside its batch is about 60 times this.
SLICE = 1 << 19
_LONG = 512
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def byte_class(*runs: tuple[int, int], inside: int = 1) -> np.ndarray:
    """Table with ``inside`` for the byte ranges given (ends included) and 0 elsewhere."""
    table = np.zeros(256, np.uint8)
    for first, last in runs:
        table[first : last + 1] = inside
    return table


LETTERS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_VALUE = np.random.default_rng(20240607).integers(1, _MASK, 256, dtype=np.uint64, endpoint=True)
_LOWERED = _VALUE[LOWER]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def slices(texts: list[bytes], classes: np.ndarray, limit: int = SLICE) -> Iterator[list[tuple[int, bytes]]]:
    """The texts as lists of (text number, part) of about ``limit`` bytes; long ones are cut between words."""
    part: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at + limit - size
            if end < len(text):
                outside = np.flatnonzero(classes[np.frombuffer(text, np.uint8, offset=end)[: 1 << 16]] == 0)
                while not len(outside) and end < len(text):
                    end += 1 << 16
                    outside = np.flatnonzero(classes[np.frombuffer(text[end : end + (1 << 16)], np.uint8)] == 0)
                end += int(outside[0]) if len(outside) else 0
            part.append((i, text[at:end]))
            size += len(part[-1][1])
            at = end
            if size >= limit:
                yield part
                part, size = [], 0
    if part:
        yield part


def runs(parts: list[tuple[int, bytes]], classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one class in the parts: buffer, start, end, class, text number, hash of the lower-cased run."""
    joined = b" ".join(p for _, p in parts)
    raw = np.frombuffer(joined, np.uint8)
    kind = classes.take(raw)
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate(([0], edge)) if len(raw) else np.zeros(0, np.int64)
    end = np.concatenate((edge, [len(raw)])) if len(raw) else np.zeros(0, np.int64)
    inside = kind[start] > 0
    start, end = start[inside], end[inside]
    size = max(SLICE * 2, 1 << max(1, len(raw) - 1).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(raw) + 1, np.uint64)
    value = _LOWERED.take(raw)
    value *= power[: len(raw)]
    np.cumsum(value, out=total[1:])
    found = mixed((total[end] - total[start]) * inverse[start])
    for i in np.flatnonzero(end - start > _LONG):
        found[i] = xxhash.xxh64_intdigest(joined[start[i] : end[i]].lower(), 7)
    lengths = np.fromiter((len(p) + 1 for _, p in parts), np.int64, len(parts))
    first = np.cumsum(lengths) - lengths
    number = np.fromiter((i for i, _ in parts), np.int32, len(parts))
    text = np.repeat(number, np.diff(np.searchsorted(start, first), append=len(start)))
    return raw, start, end, kind[start], text, found


def word_hashes(texts: list[bytes], classes: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word, in order."""
    hashes, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for parts in slices(texts, classes):
        *_, number, found = runs(parts, classes)
        hashes.append(found)
        numbers.append(number)
    return np.concatenate(hashes), np.concatenate(numbers)


def hash_of(word: bytes) -> int:
    """Hash of one word, equal to the one ``runs`` gives it."""
    if len(word) > _LONG:
        return xxhash.xxh64_intdigest(word.lower(), 7)
    total = sum(int(_VALUE[LOWER[b]]) * pow(_BASE, i, 1 << 64) for i, b in enumerate(word)) & _MASK
    return int(mixed(np.array([total], np.uint64))[0])


def portions(batches: Iterator, column: str = "text", limit: int = 4 << 20) -> Iterator:
    """The same rows in smaller Arrow batches: of about ``limit`` bytes of text, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        first = 0
        while first < batch.num_rows:
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
