"""Hilbert keys of points on a grid."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (rows) whose coordinates are `bits` wide; dims * bits must be under 64.

    From the highest bit down, each level's orthant is put in Gray-code order, after the turns and
    reflections that the levels above call for have been undone on the lower bits.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint64(level)
        below = (one << bit) - one
        for d in range(dims):
            up = (x[d] >> bit & one).astype(bool)
            flip = np.where(up, below, np.uint64(0))
            swap = np.where(up, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] ^= flip | swap
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[dims - 1] >> np.uint64(level) & one).astype(bool), (one << np.uint64(level)) - one, np.uint64(0))
    x ^= fix
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << one | (x[d] >> np.uint64(level) & one)
    return key.astype(np.int64)
