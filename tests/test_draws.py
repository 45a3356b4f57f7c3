"""Bootstrap weights: drawn in small blocks, equal to the plain arithmetic."""

import numpy as np

from tidemark.operators import contrasts as C

M = 2147483647


def plain(ids, replicates, seed):
    a = (ids.astype(np.int64) % M)[:, None]
    b = ((replicates.astype(np.int64) * 1103515245 + seed) % M)[None, :]
    h = (a * 48271 + b) % M
    h ^= h >> 15
    h = (h * 69621 + b) % M
    h ^= h >> 13
    h = (h * 1103515245 + 12345) % M
    h ^= h >> 16
    return np.searchsorted(C.POISSON_STEPS, h / float(M), side="right").astype(np.float64)


def test_blocks_equal_the_plain_arithmetic():
    ids = np.r_[np.arange(300), -1, M - 1, M, M + 1, 2 * M, np.random.default_rng(5).integers(-(10**14), 10**14, 500)]
    for n in (1, 7, 1000, 10_000):
        assert (C.poisson_weights(ids, np.arange(n), 1337) == plain(ids, np.arange(n), 1337)).all()


def test_every_bound_is_the_least_number_that_reaches_its_step():
    for h, step in zip(C._BOUNDS, C.POISSON_STEPS):
        assert h / float(M) >= step and (h - 1) / float(M) < step
    h = np.concatenate([C._BOUNDS + d for d in (-1, 0, 1)])
    h = h[(h >= 0) & (h <= M)]
    cell = C._BY_CELL[h >> 15]
    exact = np.searchsorted(C.POISSON_STEPS, h / float(M), side="right")
    assert ((cell == exact) | (cell == C._MIXED)).all()


def test_a_block_stays_small_however_many_rows_and_replicates():
    blocks = [w.size for _, w in C._draw_blocks(np.arange(1024), np.arange(10_000), 1)]
    assert max(blocks) <= 32768 and sum(blocks) == 1024 * 10_000
