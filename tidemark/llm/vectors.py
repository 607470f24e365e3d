"""Vectors in list columns, read by their flat values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_length(column: pa.Array, also: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) of each vector length in a list column, without the rows that take no part:
    vectors that are null, empty, zero or hold null or non-finite parts, and rows where `also` is false."""
    if pa.types.is_null(column.type):
        return
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null parts become NaN
    lengths = np.diff(offsets)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0)
    if also is not None:
        ok &= also
    for length in np.unique(lengths[ok]).tolist():
        rows = np.flatnonzero(ok & (lengths == length))
        x = values[offsets[rows][:, None] + np.arange(length)]
        good = np.isfinite(x).all(1) & x.any(1)
        if good.any():
            yield rows[good], x[good]


def as_binary(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    size = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def as_matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """The rows of a binary column of equal lengths without nulls, as a matrix."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)
            out.append(np.frombuffer(c.buffers()[2], np.uint8, int(ends[-1] - ends[0]), int(ends[0])).view(kind).reshape(len(c), -1))
    if not out:
        return np.zeros((0, 0), kind)
    return out[0] if len(out) == 1 else np.concatenate(out)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows none of which is zero, also of very large or small parts."""
    most = np.abs(x).max(1)
    return np.linalg.norm(x / most[:, None], axis=1) * most
