"""Vector columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column, dtype) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.array(column.value_lengths().to_pylist(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    if not len(width) or not width.max():
        return np.zeros((len(width), 1), dtype)
    if (width == width[0]).all():
        return flat.reshape(len(width), -1)
    out = np.zeros((len(width), width.max()), dtype)
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact, as 64-bit integers; what 64 bits cannot hold stops at their ends."""
    bound = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, right.shape[1])
    if bound < 2.0**53:
        kind = np.float32 if bound < 2.0**24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y)), -(2**63)), 2**63 - 1) for y in right] for x in left]
    return np.array(exact, np.int64).reshape(len(left), len(right))
