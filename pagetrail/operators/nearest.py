"""Vector search inside tasks: matrices from Arrow columns, and the k nearest of a block of vectors for a block of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 4096
CELLS = 1 << 24  # distances held at once


def matrix(column: pa.ChunkedArray | pa.Array, ids: pa.ChunkedArray | pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of doubles (float32 storage widened); ValueError names the first id whose vector has another length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dims or 0))
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), -1)
    dims = int(lengths[0]) if dims is None else dims
    wrong = np.flatnonzero(lengths != dims)
    if len(wrong):
        raise ValueError(f"vector dimension mismatch for id {ids[int(wrong[0])].as_py()}: expected {dims}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def exact_distances(x: np.ndarray, q: np.ndarray, metric: str, decimals: int) -> np.ndarray:
    """Rounded distance of each row of ``x`` to the same row of ``q``."""
    if metric == "l2":
        d = np.sqrt(((x - q) ** 2).sum(1))
    else:
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1.0 - (x * q).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1))
    return np.round(d, decimals)


class Best:
    """The k best (distance, id) of every query of a block, filled chunk by chunk.

    Distances of a chunk come from one matrix product; what may be among the best
    (with a margin for its rounding and for ties) is measured exactly. Equal
    rounded distances are ranked by id.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, decimals: int):
        self.queries, self.k, self.metric, self.decimals = queries, k, metric, decimals
        self.norms = (queries * queries).sum(1)
        self.limit = np.full(len(queries), np.inf)  # of the estimate
        self.row, self.id, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _estimates(self, x: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Monotone stand-ins for the distances (queries lo to hi by rows of x), and their margins."""
        q, qn, xn = self.queries[lo:hi], self.norms[lo:hi], (x * x).sum(1)
        if self.metric == "l2":
            return qn[:, None] - 2 * (q @ x.T) + xn, 1e-8 * (1 + qn + xn.max(initial=0.0))
        with np.errstate(invalid="ignore", divide="ignore"):
            e = 1 - (q @ x.T) / np.sqrt(qn[:, None] * xn)
        return np.nan_to_num(e, nan=np.inf, posinf=np.inf, neginf=-np.inf), np.full(hi - lo, 1e-8)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        for at in range(0, len(x), CHUNK):
            part, own = x[at : at + CHUNK], ids[at : at + CHUNK]
            step = max(1, CELLS // max(1, len(part)))
            found = []
            for lo in range(0, len(self.queries), step):
                hi = min(lo + step, len(self.queries))
                e, margin = self._estimates(part, lo, hi)
                bound = self.limit[lo:hi]
                if len(part) > self.k:
                    bound = np.minimum(bound, np.partition(e, self.k - 1, axis=1)[:, self.k - 1] + margin)
                r, c = np.nonzero(e <= bound[:, None])
                r += lo
                found.append((r, own[c], exact_distances(part[c], self.queries[r], self.metric, self.decimals)))
            self._keep(found)

    def _keep(self, found: list) -> None:
        row = np.concatenate([self.row, *[f[0] for f in found]])
        id_ = np.concatenate([self.id, *[f[1] for f in found]])
        distance = np.concatenate([self.distance, *[f[2] for f in found]])
        order = np.lexsort((id_, distance, row))  # NaN comes last
        row, id_, distance = row[order], id_[order], distance[order]
        starts = np.searchsorted(row, np.arange(len(self.queries)))
        rank = np.arange(len(row)) - starts[row]
        kept = rank < self.k
        self.row, self.id, self.distance = row[kept], id_[kept], distance[kept]
        last = np.flatnonzero(kept & (rank == self.k - 1))
        d = distance[last]
        with np.errstate(invalid="ignore"):
            estimate = d * d if self.metric == "l2" else d
            margin = 1e-8 * (1 + 2 * self.norms[row[last]] + estimate) * 2 if self.metric == "l2" else 1e-8
        self.limit[row[last]] = np.where(np.isnan(d), np.inf, estimate + margin)
