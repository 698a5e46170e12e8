"""Polynomial hashes of byte ranges, vectorised with prefix sums over uint64 (wrapping) arithmetic."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word (two multiply/xor-shift rounds)."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


@functools.lru_cache(maxsize=4)
def _random(seed: int) -> tuple[np.ndarray, int]:
    g = np.random.Generator(np.random.PCG64(seed))
    return g.integers(1, 2**64, 256, dtype=np.uint64), int(g.integers(1, 2**63, dtype=np.uint64)) * 8 % 2**64 | 5


@functools.lru_cache(maxsize=4)
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = _random(seed)[1]
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.ones(n, np.uint64)
        size = 1
        while size < n:  # p[size:2*size] = p[:size] * b**size
            m = min(size, n - size)
            p[size : size + m] = p[:m] * U(pow(b, size, 2**64))
            size *= 2
        out.append(p)
    return out[0], out[1]


class RangeHash:
    """Hashes of any [start, end) of one byte array after a linear preparation."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        size = 1 << max(16, n.bit_length())
        pw, self.inverse = _powers(seed, size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_random(seed)[0][data] * pw[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the ranges, without their lengths."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        """Mixed hashes of all ranges of one width, by start."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)
