"""Connected components of an edge table by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is one node of its component.

    Each round maps every vertex of the current graph to the smallest vertex of
    its closed neighbourhood and contracts the edges; a star vanishes in two
    rounds, any component in a number of rounds that grows with the logarithm
    of its size in practice. Every round is stored and the one before deleted, nothing is collected.
    """
    edges = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks")
        if labels is None:
            labels = stored(step.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            hop = step.select(F.col("a").alias("label"), "to")
            before = labels
            labels = stored(labels.join(hop, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            discard(before)
        left = step.select(F.col("a"), F.col("to").alias("ta"))
        right = step.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        before = edges
        edges = edges.join(left, "a").join(right, "b").filter("ta <> tb")
        edges = stored(edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(before)
        discard(step)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
