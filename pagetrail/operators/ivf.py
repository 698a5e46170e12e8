"""Approximate k-NN with an inverted file (Q5): k-means cells, one list of vectors per cell, nearest cells probed.

Fitting: at most ``SAMPLE`` vectors, chosen by a hash of their id, train the
cells with a few rounds of k-means (about two cells for three vectors, at most
``MAX_CELLS``); the centroids are of bounded size. Every vector is then put in the list of its nearest
cell. Long lists are cut into pieces of ``PIECE`` vectors by a hash of the id, so a cell
that holds a third of all vectors is many tasks.

Searching: a query probes its nearest cells until they hold ``share`` of all
vectors (at least one cell). The queries of a piece meet its vectors in one
task, which keeps the k best of each query by exact distance; only these are
shuffled for the final ranking. No pair of a query and a vector is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.scratch import stored
from .nearest import Best, matrix

SAMPLE = 65_536
MAX_CELLS = 4_096
ROUNDS = 3
PIECE = 65_536
CHUNK = 4_096
RANK_DECIMALS = 9
HIT = "qid long, doc_id long, distance double"


@dataclass(frozen=True)
class Index:
    """Centroids, number of vectors of each cell, and the lists (doc_id, embedding, cell, piece)."""

    centroids: np.ndarray
    sizes: np.ndarray
    lists: DataFrame

    @property
    def total(self) -> int:
        return int(self.sizes.sum())


def nearest_cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norms = (centroids * centroids).sum(1)
    return np.concatenate([(norms - 2 * x[i : i + CHUNK] @ centroids.T).argmin(1) for i in range(0, len(x), CHUNK)] or [np.zeros(0, np.int64)])


def trained(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means on the sample, started at its first vectors; a cell that loses all vectors stays where it is."""
    centroids = sample[:cells].copy()
    for _ in range(rounds):
        at = nearest_cells(sample, centroids)
        count = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def build(vectors: DataFrame, *, id_col: str = "page_id", vec_col: str = "embedding", cells: int | None = None) -> Index:
    """Fit the cells on a bounded sample and index every vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vec_col).alias("embedding"))
    n = rows.count()
    if not n:
        return Index(np.zeros((0, 0)), np.zeros(0, np.int64), spark.createDataFrame([], "doc_id long, embedding array<float>, cell int, piece int"))
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * min(1.0, 0.9 * SAMPLE / n))))
    drawn = (rows.filter(keep) if n > SAMPLE else rows).limit(SAMPLE).toArrow()
    sample = matrix(drawn["embedding"], drawn["doc_id"])
    sample = sample[np.random.Generator(np.random.PCG64(7)).permutation(len(sample))]
    centroids = trained(sample, cells or max(1, min(MAX_CELLS, 2 * n // 3, 2 * len(sample) // 3)))
    sent = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = nearest_cells(matrix(b.column(1), b.column(0), sent.value.shape[1]), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at.astype(np.int32))], ["doc_id", "embedding", "cell"])

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = stored(rows.mapInArrow(assign, f"doc_id long, embedding {kind}, cell int"), "ivf_lists")
    sizes = np.zeros(len(centroids), np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row a cell
        sizes[r["cell"]] = r["count"]
    pieces = [int(-(-s // PIECE)) for s in sizes]
    if max(pieces) > 1:
        many = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for c, p in enumerate(pieces) if p > 1 for v in (c, p)]), F.col("cell")), F.lit(1))
    else:
        many = F.lit(1)
    return Index(centroids, sizes, placed.withColumn("piece", F.pmod(F.xxhash64("doc_id"), many).cast("int")))


def probes(index: Index, queries: DataFrame, share: float) -> DataFrame:
    """qid, vector, cell, piece: what each query visits."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast((index.centroids, index.sizes))
    budget = share * index.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes = sent.value
        norms, used = (centroids * centroids).sum(1), sizes > 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                q = matrix(b.column(1), b.column(0), centroids.shape[1])
                order = np.argsort(np.where(used, norms - 2 * q @ centroids.T, np.inf), axis=1, kind="stable")
                seen = np.cumsum(sizes[order], axis=1)
                visited = (seen <= budget) & used[order]
                visited[:, 0] = True
                r, c = np.nonzero(visited)
                cell = order[r, c]
                pieces = -(-sizes[cell] // PIECE)
                r, cell = np.repeat(r, pieces), np.repeat(cell, pieces)
                piece = np.arange(len(r)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r)), b.column(1).take(pa.array(r)), pa.array(cell.astype(np.int32)), pa.array(piece.astype(np.int32))],
                    ["qid", "vector", "cell", "piece"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("qid", "vector").mapInArrow(run, f"qid long, vector {kind}, cell int, piece int")


def candidates(index: Index, queries: DataFrame, share: float) -> DataFrame:
    """qid, cells probed and vectors compared: what a search with ``share`` costs."""
    if not index.total:
        return queries.select("qid", F.lit(0).alias("cells"), F.lit(0).cast("long").alias("compared"))
    pairs = probes(index, queries, share).join(index.lists.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("n")), ["cell", "piece"])
    return pairs.groupBy("qid").agg(F.count_distinct("cell").alias("cells"), F.sum("n").alias("compared"))


def search(index: Index, queries: DataFrame, *, k: int, share: float) -> DataFrame:
    """qid, doc_id, distance: the k best of every visited piece; rank them per query for the result."""
    if not index.total:
        return queries.sparkSession.createDataFrame([], HIT)

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        best = Best(matrix(right["vector"], right["qid"]), k, "l2", RANK_DECIMALS)
        best.add(matrix(left["embedding"], left["doc_id"], best.queries.shape[1]), left["doc_id"].to_numpy())
        return pa.table({"qid": right["qid"].to_numpy()[best.row], "doc_id": best.id, "distance": best.distance})

    key = ("cell", "piece")
    return index.lists.groupBy(*key).cogroup(probes(index, queries, share).groupBy(*key)).applyInArrow(meet, HIT)
