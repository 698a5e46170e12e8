"""Vector code compression: product quantisation with active-entry Lloyd rounds on integers.

Components become ``floor(256 * x)`` and every vector is cut into equal parts;
each part position has a codebook of its own. All arithmetic is on integers, so
results do not depend on partitions or on the order of tasks.

The codebooks start as the parts of the vectors with the smallest ids. The
first assignment compares every part with every entry and stores, next to the
codes, the exact distance of each part to its entry. After a round only some
entries have moved. A part whose entry stayed fixed keeps its stored distance
and is compared with the moved entries only: all other fixed entries lost
before at the same distances. Parts whose entry moved are scanned in full. Equal distances go to the
lower index in both cases, so the result equals a full scan.

Codes and distances of a round are a stored table and the table of the round
before is deleted then. Each task adds up its parts per entry; these sums
(parts x entries x positions, whatever the number of rows) are shuffled, and
the codebooks of that fixed size go to the driver and with the next round to the tasks.

Rows: vectors that are null or empty or hold null or non-finite components are
dropped; repeated rows count as often as they stand. Null ids come last in the
choice of the first entries; equal ids are ordered by their vectors. With fewer
rows than entries the codebooks have as many entries as rows. An empty table
gives no rows. Null labels are one group. Vectors of different lengths, or of a
length that the parts do not divide, raise ValueError, components too large for
exact 64-bit distances OverflowError. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, in_arrow, stored
from .vectors import dense

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 8192
STATE = "vec_id {id}, label {label}, x array<int>, codes binary, distances array<long>"


def integers(vectors: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * vectors)
    if x.size and np.abs(x).max() >= 2**31:
        raise OverflowError("vector components beyond 8 million")
    return x.astype(np.int64)


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries, as integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
    bound = 4 * most * most * x.shape[1]
    if bound >= 2**62:
        raise OverflowError("components too large for exact distances")
    kind = np.float64 if bound < 2**53 else np.int64  # doubles below 2**53 are exact, and faster
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals) of every row and its distance, over all entries."""
    d = squared_distances(x, entries)
    codes = d.argmin(1)
    return codes, d[np.arange(len(x)), codes]


def rescan(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, codes: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """:func:`scan` after only the entries ``moved`` changed, from the codes and distances before; also the number of distances computed."""
    codes, distances = codes.copy(), distances.copy()
    lost = moved[codes]
    active = np.flatnonzero(moved)
    computed = int(lost.sum()) * len(entries) + int((~lost).sum()) * len(active)
    if lost.any():
        codes[lost], distances[lost] = scan(x[lost], entries)
    fixed = np.flatnonzero(~lost)
    if len(active) and len(fixed):
        best, at = scan(x[fixed], entries[active])
        best = active[best]
        better = (at < distances[fixed]) | ((at == distances[fixed]) & (best < codes[fixed]))
        codes[fixed[better]], distances[fixed[better]] = best[better], at[better]
    return codes, distances, computed


def digest(books: np.ndarray) -> str:
    """sha256 of the entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(matrix.ravel(), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    packed = codes.astype(np.uint8)
    return pa.record_batch(
        [ids, labels, _lists(x, pa.int32()), pa.array([r.tobytes() for r in packed], pa.binary()), _lists(distances, pa.int64())],
        ["vec_id", "label", "x", "codes", "distances"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _cut(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """rows x parts x positions."""
    parts, _, width = books.shape
    if x.shape[1] != parts * width:
        raise ValueError(f"vectors of different lengths: {x.shape[1]} and {parts * width}")
    return x.reshape(len(x), parts, width)


def first_assignment(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            kept, vectors = dense(batch.column(2))
            if not kept.any():
                continue
            x = integers(vectors)
            cut = _cut(x, books)
            found = [scan(cut[:, p], books[p]) for p in range(len(books))]
            mask = pa.array(kept)
            yield _state(batch.column(0).filter(mask), batch.column(1).filter(mask), x, np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1))

    return run


def next_assignment(before: np.ndarray, books: np.ndarray):
    moved = (before != books).any(2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(2), rows)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(rows, -1).astype(np.int64)
            distances = _matrix(batch.column(4), rows)
            cut = _cut(x, books)
            found = [rescan(cut[:, p], books[p], moved[p], codes[:, p], distances[:, p]) for p in range(len(books))]
            yield _state(batch.column(0), batch.column(1), x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1))

    return run


def _entry_sums(shape: tuple[int, int, int]):
    """Per part, entry and position: sum and number of the parts assigned there by one task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in _blocks(batches):
            rows = batch.num_rows
            if not rows:
                continue
            cut = _matrix(batch.column(0), rows).reshape(rows, parts, width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(rows, parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], cut[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e, w = (a.ravel() for a in np.indices(shape).astype(np.int32))
        used = counts[p, e] > 0
        yield pa.record_batch([pa.array(a[used]) for a in (p, e, w, sums.ravel(), counts[p, e])], ["part", "entry", "position", "s", "n"])

    return run


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    schema = "part int, entry int, position int, s long, n long"
    sums = in_arrow(state.select("x", "codes"), _entry_sums(books.shape), schema).groupBy("part", "entry", "position").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # parts x entries x positions at most
        out[r.part, r.entry, r.position] = r.s // r.n
    return out


def _first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """parts x entries x positions from the rows with the smallest ids."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            kept, found = dense(batch.column(1))
            if kept.any():
                yield pa.record_batch([batch.column(0).filter(pa.array(kept)), _lists(integers(found), pa.int32())], ["vec_id", "x"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = in_arrow(vectors.select("vec_id", "embedding"), pick, f"vec_id {kind}, x array<int>")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return None
    if len({len(r.x) for r in first}) > 1 or len(first[0].x) % parts:
        raise ValueError(f"vectors must have one length that {parts} divides")
    x = np.array([r.x for r in first], np.int64)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2).copy()


def compressed(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (error over equal labels), codebooks_sha256.

    At most 256 entries, so that a code is one byte.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    vectors = embeddings.select("vec_id", "label", "embedding")
    kinds = {"id": vectors.schema["vec_id"].dataType.simpleString(), "label": vectors.schema["label"].dataType.simpleString()}
    books = _first_books(vectors, parts, entries)
    if books is None:
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    schema = STATE.format(**kinds)
    state = stored(in_arrow(vectors, first_assignment(books), schema), "vector_codes")
    for _ in range(rounds):
        before, books = books, _updated(state, books)
        after = stored(in_arrow(state, next_assignment(before, books), schema), "vector_codes")
        discard(state)
        state = after
    error = F.aggregate("distances", F.lit(0).cast("long"), lambda a, d: a + d)
    coded = state.select("vec_id", F.col("label").alias("_label"), F.lower(F.hex("codes")).alias("code"), error.alias("error"))
    by_label = stored(coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error")), "label_errors")
    # the size of the stored totals decides between broadcast and shuffle; a hot label is split by the skew join
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
