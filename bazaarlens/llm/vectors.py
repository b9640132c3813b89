"""Vectors of an Arrow list column as numpy rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows without a null or non-finite component, by length: length, row numbers, one vector per line.

    Null vectors and those without components belong to no length.
    """
    column = column.cast(pa.large_list(column.type.value_type))
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    numbers = column.values.to_numpy(zero_copy_only=False)  # a null becomes NaN
    if numbers.dtype.kind != "f":
        numbers = numbers.astype(np.float64)
    for length in np.unique(size[present]):
        rows = np.flatnonzero(present & (size == length))
        if length:
            found = numbers[offsets[rows][:, None] + np.arange(length)]
            whole = np.isfinite(found).all(axis=1)
            yield int(length), rows[whole], found[whole]


def vector_portions(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller Arrow batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
