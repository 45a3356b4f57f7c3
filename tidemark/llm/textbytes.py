"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Texts are taken whole. ``slices`` groups neighbouring texts into blocks of half a
megabyte, so the arrays of one block, a few dozen bytes per byte of text, stay small
whatever the batch holds; a text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_RNG = np.random.default_rng(20240611)
#: One random odd-free 64-bit value per byte; capital letters share their small letter's.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EXACT_VALUE = BYTE_VALUE.copy()  # the same without folding
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
_STEP = 0x9E3779B97F4A7C15
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)

#: Space and the bytes 9 to 13 part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def parts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 places where its texts begin and end; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes; one text at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(first: int, n: int) -> np.ndarray:
    """1, first, first^2, ... modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k = 1
    while k < n:
        take = min(k, n - k)
        out[k : k + take] = out[:take] * np.uint64(pow(first, k, 1 << 64))
        k += take
    return out


_UP = powers(_STEP, BLOCK_BYTES)
_DOWN = powers(_STEP_INVERSE, BLOCK_BYTES)


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of several texts, and the number of words before each text."""
    gap = np.ones(len(raw) + 1, bool)
    gap[:-1] = IS_SPACE[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = True
    before[1:] = gap[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    start = ~gap & before
    start[inner] = ~gap[inner]
    end = gap & ~before
    end[inner] |= ~gap[inner - 1]
    begins, ends = np.flatnonzero(start), np.flatnonzero(end)
    return begins, ends, np.searchsorted(begins, at, side="left")


def word_hashes(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each word, ASCII capitals folded unless ``values`` tell them apart. Words may be of any length."""
    out = np.empty(len(begins), np.uint64)
    lo = 0
    while lo < len(begins):
        base = int(begins[lo])
        hi = max(int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")), lo + 1)
        size = int(ends[hi - 1]) - base
        up, down = (_UP, _DOWN) if size <= BLOCK_BYTES else (powers(_STEP, size), powers(_STEP_INVERSE, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[raw[base : base + size]] * up[:size], out=sums[1:])
        b, e = begins[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        lo = hi
    return out
