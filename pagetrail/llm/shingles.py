"""Word shingles of whole texts as 64-bit hashes, vectorised over an Arrow buffer."""

from __future__ import annotations

import numpy as np

from .hashing import RangeHash, U, mix

BLOCK = 1 << 18  # bytes of one hashing step
ROWS = 1 << 20  # bytes of text handled together; their words and shingles take some fifteen times as much

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def row_groups(off: np.ndarray, limit: int = ROWS):
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    r, n = 0, len(off) - 1
    while r < n:
        stop = max(r + 1, int(np.searchsorted(off, off[r] + limit, "right")) - 1)
        yield r, min(stop, n)
        r = min(stop, n)


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word: runs of bytes other than ASCII white space, A-Z lower-cased."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off[(off >= 0) & (off <= n)]] = True
    hashes, starts, lo = [], [], 0
    while lo < n:
        hi = min(lo + BLOCK, n)
        if hi < n:  # end a block at a word's edge
            edge = np.flatnonzero(_WHITE[data[lo:hi]] | cut[lo:hi])
            if len(edge) and edge[-1] > 0:
                hi = lo + int(edge[-1])
            else:
                while hi < n and not (_WHITE[data[hi]] or cut[hi]):
                    hi += 1
        part = _LOWER[data[lo:hi]]
        ink = ~_WHITE[part]
        first = ink.copy()
        first[1:] &= ~ink[:-1] | cut[lo + 1 : hi]
        last = ink.copy()
        last[:-1] &= ~ink[1:] | cut[lo + 1 : hi]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(mix(RangeHash(part, 3).of(s, e) + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        lo = hi
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(off, starts, "right") - 1


def shingle_sets(off: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words of every row, sorted by (row, hash): (row, hash).

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    words, row = word_hashes(off, data)
    n = len(words)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= k:
        full = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            full = mix(full * U(31) + words[i : n - k + 1 + i])
        ok = row[: n - k + 1] == row[k - 1 :]
        full, at = full[ok], row[: n - k + 1][ok]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.cumsum(count) - count
        one = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = count[short] > i
            one[has] = mix(one[has] * U(31) + words[begin[short[has]] + i])
        full = np.concatenate([full, mix(one + count[short].astype(np.uint64))])
        at = np.concatenate([at, short])
    order = np.lexsort((full, at))
    full, at = full[order], at[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (at[1:] != at[:-1])
    return at[new], full[new]
