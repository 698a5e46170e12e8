"""Embedding whitening: distributed covariance, own symmetric eigensolver, broadcast projection.

Vectors become integers ``x = floor(64 * c) + 1000000``. The fit list is each
distinct x vector once; Spark finds it with one shuffle on the packed vector,
after equal vectors of a task are merged, and stores it. Two passes over the
stored list follow, each reduced in the tasks before it is shuffled:

* number ``n`` and per-dimension sums ``S`` (exact integers);
* products of the vectors centred on the integers ``m`` next to their means.
  These sums are exact integers as well, and what is left of the means
  (``S - n * m``, less than half a unit each) is taken off exactly, so the
  covariance is rounded once and does not depend on partitions or on the order
  of tasks.

The covariance (dimension squared, whatever the number of rows) is reduced to a
tridiagonal matrix by Householder reflections on the driver; the leading
eigenvalues are bisected with Sturm counts and their vectors found by inverse
iteration, reorthogonalised within clusters of close eigenvalues. The projection
is sent to the tasks, and a last pass projects every row.

Rows: vectors that are null or empty or hold null or non-finite entries are
dropped; repeated rows appear as often as they stand, and once in the fit list;
null ids stay. An empty table gives no rows. Components without variance (below
``LEAST`` of the largest eigenvalue) cannot be scaled and are left out, so equal
vectors only give no rows. Vectors of different lengths raise ValueError,
entries beyond 33 million OverflowError. A ``deviation`` too large for a long is
null. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, in_arrow, stored
from .vectors import dense

COMPONENTS = 16
LEAST = 1e-10
SCALE, SHIFT = 64, 1_000_000
EXACT = 2**53  # doubles below hold every integer
BLOCK = 4096


# ---- eigenvalues and vectors of one symmetric matrix -------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors u with H = I - 2uu' (u of unit length or zero, for rows k+1...)."""
    a = np.array(a, np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size > 0 and np.any(u[1:]):
            u[0] += math.copysign(size, u[0])
            u /= np.linalg.norm(u)
            part = a[k + 1 :, k + 1 :]
            p = 2 * (part @ u)
            p -= (u @ p) * u
            part -= np.outer(u, p) + np.outer(p, u)
            a[k + 1 :, k] -= 2 * (u @ a[k + 1 :, k]) * u
            a[k, k + 1 :] = a[k + 1 :, k]
        else:
            u = np.zeros(d - k - 1)
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: number of eigenvalues of the tridiagonal matrix smaller than each x."""
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    squares = off * off
    q = diagonal[0] - x
    count = np.zeros(x.shape, np.int64)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - x - squares[i - 1] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)  # counts as below, and so does what follows from it
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all of them at once."""
    d = len(diagonal)
    around = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    pad = np.finfo(float).eps * d * max(np.abs(low[0]), np.abs(high[0]))
    low, high = low - pad, high + pad
    wanted = d - np.arange(k)  # the j-th largest has fewer than d - j eigenvalues below it
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        left = below(diagonal, off, middle) >= wanted
        high, low = np.where(left, middle, high), np.where(left, low, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) z = b by elimination with row exchanges."""
    d = len(diagonal)
    main, up, up2, z = diagonal - shift, np.append(off, 0.0), np.zeros(d), b.copy()
    for i in range(d - 1):
        under, nxt, after = off[i], main[i + 1], up[i + 1]
        if abs(under) > abs(main[i]):  # the lower row leads
            f = main[i] / under
            main[i], main[i + 1] = under, up[i] - f * nxt
            up2[i], up[i], up[i + 1] = after, nxt, -f * after
            z[i], z[i + 1] = z[i + 1], z[i] - f * z[i + 1]
        else:
            main[i] = main[i] if abs(main[i]) > tiny else tiny
            f = under / main[i]
            main[i + 1] = nxt - f * up[i]
            z[i + 1] -= f * z[i]
    for i in range(d - 1, -1, -1):
        if abs(main[i]) < tiny:
            main[i] = tiny
        z[i] = (z[i] - (up[i] * z[i + 1] if i + 1 < d else 0.0) - (up2[i] * z[i + 2] if i + 2 < d else 0.0)) / main[i]
        if abs(z[i]) > 1e100:
            z[i:] *= 1e-100
            z[:i] *= 1e-100
    return z


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and their unit eigenvectors as columns, the entry of largest size positive."""
    d = len(a)
    k = min(k, d)
    size = np.abs(a).max()
    if size == 0:
        return np.zeros(k), np.eye(d, k)
    diagonal, off, reflections = tridiagonal(a / size)
    values = leading_values(diagonal, off, k)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    tiny, near = np.finfo(float).eps * norm, 1e-3 * norm
    start = np.random.Generator(np.random.PCG64(7))
    found = np.zeros((d, k))
    first = 0  # of the cluster
    for j in range(k):
        if j and values[j - 1] - values[j] > near:
            first = j
        z = start.standard_normal(d)
        for _ in range(5):
            z = _solve(diagonal, off, values[j], z / np.linalg.norm(z), tiny)
            z /= np.linalg.norm(z)
            for _ in range(2):
                z -= found[:, first:j] @ (found[:, first:j].T @ z)
        found[:, j] = z / np.linalg.norm(z)
    for step in range(len(reflections) - 1, -1, -1):
        u = reflections[step]
        found[step + 1 :] -= 2 * np.outer(u, u @ found[step + 1 :])
    most = found[np.abs(found).argmax(0), np.arange(k)]
    return values * size, found * np.where(most < 0, -1.0, 1.0)


# ---- passes over the table ---------------------------------------------------------------------


def integers(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * vectors) + SHIFT
    if x.size and np.abs(x).max() >= 2**31:
        raise OverflowError("vector entries beyond 33 million")
    return x.astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, vectors = dense(batch.column(0))
        x = integers(vectors).astype("<i4")
        yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])


def _unpack(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").astype(np.int64).reshape(-1, dims)


def _cells(names: tuple[str, ...], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], list(names))


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for x in _unpack(batches, dims):
            total += x.sum(0)
            n += len(x)
        if n:
            yield _cells(("i", "s", "n"), np.arange(dims, dtype=np.int32), total, np.full(dims, n, np.int64))

    return run


def _products(dims: int, centre: list[int]):
    m = np.array(centre, np.int64)
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bound = np.zeros((dims, dims), np.int64), 0
        for x in _unpack(batches, dims):
            y = x - m
            square = int(np.abs(y).max()) ** 2 + 1
            exact = square < EXACT  # products of doubles are exact, or else of integers
            rows = max(1, min(BLOCK, (EXACT if exact else 2**62) // square))
            for at in range(0, len(y), rows):
                part = y[at : at + rows].astype(np.float64) if exact else y[at : at + rows]
                if bound + square * len(part) >= 2**62:
                    yield out(total)
                    total, bound = np.zeros((dims, dims), np.int64), 0
                total += (part.T @ part).astype(np.int64)
                bound += square * len(part)
        if bound:
            yield out(total)

    def out(total: np.ndarray) -> pa.RecordBatch:
        return _cells(("i", "j", "s"), upper[0].astype(np.int32), upper[1].astype(np.int32), total[upper])

    return run


@dataclass(frozen=True)
class Whitening:
    """What the tasks need to project: count, sums, components as columns, eigenvalues, trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - np.array(self.sums, np.int64)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n) @ (self.components / np.sqrt(self.values))


def _projected_products(w: Whitening):
    """Sums and products of the projections of fit vectors."""
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k + 1, k)), False
        for x in _unpack(batches, len(w.sums)):
            p = w.project(w.centred(x))
            total[:k] += p.T @ p
            total[k] += p.sum(0)
            seen = True
        if seen:
            i, j = np.indices((k + 1, k)).reshape(2, -1).astype(np.int32)
            yield _cells(("i", "j", "s"), i, j, total.ravel())

    return run


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of the distinct vectors of ``column``, and its identity error; None without variance."""
    packed = in_arrow(embeddings.select(column), _pack, "x binary")
    listed = stored(packed.distinct(), "fit_list")
    sizes = listed.agg(F.min(F.length("x")), F.max(F.length("x"))).first()
    if sizes[0] is None:
        discard(listed)
        return None
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of different lengths: {sizes[0] // 4} and {sizes[1] // 4}")
    dims = sizes[0] // 4
    totals = in_arrow(listed, _sums(dims), "i int, s long, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    per_dim = {r.i: r for r in totals.collect()}  # one row per dimension
    n, sums = per_dim[0].n, [int(per_dim[i].s) for i in range(dims)]
    if n >= 2**32:
        raise OverflowError("more than 2**32 distinct vectors")
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]  # n times what the means differ from the centres
    cells = in_arrow(listed, _products(dims, centre), "i int, j int, s long").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    covariance = np.zeros((dims, dims))
    for r in cells.collect():  # dimension squared
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / n**2
    trace = float(np.trace(covariance))
    if not trace > 0:
        discard(listed)
        return None
    values, vectors = leading(covariance, components)
    good = values > LEAST * values[0]
    made = Whitening(n, sums, vectors[:, good], values[good], trace)
    k = len(made.values)
    rows = in_arrow(listed, _projected_products(made), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1, k))
    for r in rows:
        total[r.i, r.j] = r.s
    mean = total[k] / n
    error = np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max()
    discard(listed)
    return made, float(error)


def deviations(centred: np.ndarray) -> pa.Array:
    """Sum of squares of each row; null where it exceeds a long."""
    if centred.size == 0 or int(np.abs(centred).max()) ** 2 * centred.shape[1] < 2**63:
        return pa.array((centred * centred).sum(1), pa.int64())
    exact = [sum(v * v for v in row) for row in centred.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whitened(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per kept row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(embeddings, column, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    model, error = fitted
    k = len(model.values)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                kept, vectors = dense(batch.column(1))
                if not kept.any():
                    continue
                centred = w.centred(integers(vectors))
                rows = len(centred)
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.record_batch(
                    [
                        batch.column(0).filter(pa.array(kept)).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, w.n, np.int64)),
                        deviations(centred).take(again),
                        pa.array(w.project(centred).ravel()),
                        pa.array(np.tile(w.values / w.trace, rows)),
                        pa.array(np.full(rows * k, error)),
                    ],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return in_arrow(embeddings.select(id_column, column), run, schema)
