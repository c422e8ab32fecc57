"""Columns of numbers as bytes: many values of a table in one row.

A row for each user or rating costs the JVM and Arrow more than the arithmetic on
it, and an array column is copied number by number. Tables that only arrays read,
round after round, hold bytes of several rows' numbers instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of a row's longest column, about: 10,000 such rows are what Spark sends to a task at a time.
ROW_BYTES = 8_192


def per_row(values: np.ndarray) -> int:
    """How many entries of ``values`` a row holds."""
    return max(1, ROW_BYTES // max(1, values.itemsize * int(np.prod(values.shape[1:]))))


def packed(values: np.ndarray, per: int) -> pa.Array:
    """``values`` as bytes, ``per`` entries a row."""
    data = np.ascontiguousarray(values)
    rows, step = -(-len(data) // per), per * data.itemsize * int(np.prod(data.shape[1:]))
    offsets = np.minimum(np.arange(rows + 1, dtype=np.int64) * step, data.nbytes).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """All numbers of a column of bytes, one row after the other."""
    parts = [np.empty(0, np.uint8)]
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            _, places, data = chunk.buffers()
            width = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
            ends = np.frombuffer(places, width)[chunk.offset : chunk.offset + len(chunk) + 1]
            if ends[-1] > ends[0]:
                parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(kind)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as the rows of a matrix."""
    flat = [c.flatten().to_numpy() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return (np.concatenate(flat) if flat else np.empty(0)).reshape(-1, width)


def runs(*keys: np.ndarray) -> Iterator[slice]:
    """Stretches in which all of the (sorted) ``keys`` stay the same."""
    n = len(keys[0])
    changes = np.zeros(max(0, n - 1), bool)
    for key in keys:
        changes |= key[1:] != key[:-1]
    edges = [0, *(np.nonzero(changes)[0] + 1).tolist(), n] if n else []
    return (slice(a, b) for a, b in zip(edges[:-1], edges[1:]))
