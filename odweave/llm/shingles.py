"""Word shingles as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

from odweave.llm.encoder import Memo

_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)
_TURN = np.uint64(33)


@lru_cache(maxsize=1)
def _memo() -> Memo:
    return Memo(xxh3_64_intdigest, 100_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memo().__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> _TURN)) * m
    return x ^ (x >> _TURN)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words, in order; with fewer words one for the whole; without words none.

    A run is the sum of its word hashes times powers of an odd number that depends on the run's length.
    """
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    factor = 0x9E3779B97F4A7C15 + 2 * size
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : n - size + 1 + k] * np.uint64(pow(factor, k + 1, 1 << 64))
    return mixed(total)
