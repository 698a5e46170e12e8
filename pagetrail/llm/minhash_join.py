"""Near-duplicate documents: MinHash signatures joined through an inverted index of coordinates.

Every distinct shingle set (a *node*; equal sets are one node) is posted under
each (coordinate, value) pair of its signature. Two sets are candidates when at
least ``matches`` of the ``coordinates`` agree, and linked when the Jaccard
similarity of the full sets, computed from the whole texts, reaches
``percent``. With 40 coordinates and 18 matches a pair of similarity 0.8 is
missed with a probability below one in a million.

* Skip merging: pairs that no other node posts cannot collide and are dropped;
  a node that keeps fewer than ``matches`` of them has no partner.
* Prefix merging: of its remaining m pairs a node posts only the m - matches + 1
  rarest (ties by value). Any two nodes with enough collisions still meet, and
  pairs that a very common shingle makes frequent are left out.
* Dense groups: in each of a few rounds every posting list names pivots (the
  first by a fixed random order), and each member is verified against those
  pivots outside its component with which it agrees most. The links are
  contracted to components. In the end all pairs of a posting list that lie in
  *different* components are compared: members outside its largest component
  meet all others. No link between components is lost,
  while a large group of near copies costs a few comparisons per member instead
  of all its pairs. Every posting then carries the smaller ones of its node, so
  two nodes meet only under the smallest pair that both post, not under all of them.
* Agreement is counted on 8 bits of every coordinate, which can only count too
  many, so pairs with too few are dropped inside the join.
* So are pairs whose sets differ too much for their sizes: the parity bitmaps of
  two sets differ in at most as many bits as the sets differ in shingles, so
  this drops no link, and it spares dense groups of related but unlinked
  documents the comparison of all their texts.

Rows: null or blank text has no shingle, is linked with nothing and is its own
component; a text of fewer than ``k`` words is one shingle. Rows that share a
``doc_id`` are judged by their texts. A null ``doc_id`` never names a component
unless all members are null; ``kept`` compares null-safe. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import U, mix
from .shared import discard, in_arrow, stored, utf8
from .shingles import row_groups, shingle_sets

COORDINATES = 40
MATCHES = 18
PARITY = 512  # bits of a set's parity bitmap
PIVOTS = (4, 16)  # of every posting list, in rounds before all pairs between components
TRIED = 3  # pivots that a member is verified against in a round
BROADCAST_IDS = 1_000_000  # ids of texts that are compared; at most 32 MB
BATCH = 4 << 20  # bytes of whole texts that go to a Python worker together; JVM and worker hold them several times while they convert them
NO_ID = -(2**63)  # stands for a null doc_id in joins


def _digests(rows: int, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit name of every row's set."""
    size = np.bincount(row, minlength=rows)
    name = np.zeros((rows, 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        begin = (np.cumsum(size) - size)[full]
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            name[full, i] = mix(np.add.reduceat(mix(h ^ U(salt)), begin) + size[full].astype(np.uint64))
    return size, name


def _binary16(name: np.ndarray) -> pa.Array:
    n = len(name)
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(name).tobytes())]
    )


def _signatures(rows: int, row: np.ndarray, h: np.ndarray, size: np.ndarray, coordinates: int) -> np.ndarray:
    """Per row the names of its (coordinate, smallest value) pairs; rows without shingles have zeros."""
    g = np.random.Generator(np.random.PCG64(7))
    full = np.flatnonzero(size)
    out = np.zeros((rows, coordinates), np.int64)
    if len(full):
        begin = (np.cumsum(size) - size)[full]
        for c in range(coordinates):
            salt, factor = g.integers(1, 2**64, dtype=np.uint64), g.integers(1, 2**64, dtype=np.uint64) | U(1)
            low = np.minimum.reduceat((h ^ salt) * factor, begin)
            out[full, c] = mix(low + U((c + 1) * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64)
    return out


def _parity(rows: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per row PARITY bits, packed in longs: bit i tells whether an odd number of shingles hash to i."""
    at = (mix(h ^ U(0xA4093822299F31D0)) % U(PARITY)).astype(np.int64)
    counts = np.bincount(row * PARITY + at, minlength=rows * PARITY).reshape(rows, PARITY)
    return np.packbits((counts & 1).astype(np.uint8), axis=1).view(np.int64)


def features(documents: DataFrame, k: int, coordinates: int = COORDINATES) -> DataFrame:
    """Per row: doc_id, th (hash of its text), n (set size), node (128-bit name of the set), sig and sketch.

    ``sig`` names the (coordinate, value) pairs of the signature; ``sketch``
    packs 8 bits of each name, so that agreeing pairs can be counted (never too
    few) without the signature, and then the parity bitmap of the set.
    """
    if coordinates % 8:
        raise ValueError("coordinates must be a multiple of 8")

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            for r0, r1 in row_groups(off):
                o = off[r0 : r1 + 1] - off[r0]
                row, h = shingle_sets(o, data[off[r0] : off[r1]], k)
                size, name = _digests(r1 - r0, row, h)
                sig = _signatures(r1 - r0, row, h, size, coordinates)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.ravel()))
                packed = np.hstack([np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64), _parity(r1 - r0, row, h)])
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, packed.size + 1, packed.shape[1], dtype=np.int32)), pa.array(packed.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(r0, r1 - r0), b.column("th").slice(r0, r1 - r0), pa.array(size.astype(np.int64)), _binary16(name), lists, sketch],
                    names=["doc_id", "th", "n", "node", "sig", "sketch"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return in_arrow(rows, run, "doc_id long, th long, n long, node binary, sig array<long>, sketch array<long>", BATCH)


def _near_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def postings(nodes: DataFrame, matches: int) -> DataFrame:
    """(pair, node): the prefix of every node that can have a partner."""
    pairs = nodes.select("node", F.explode("sig").alias("pair"))
    shared = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    by_node = Window.partitionBy("node")
    live = (
        pairs.join(shared, "pair")
        .withColumn("m", F.count(F.lit(1)).over(by_node))
        .withColumn("i", F.row_number().over(by_node.orderBy("f", "pair")))
    )
    return live.filter(F.col("i") <= F.col("m") - matches + 1).select("pair", "node")


def _agreeing(a: Column, b: Column, words: int) -> Column:
    """Number of agreeing bytes of two sketches of so many longs."""
    total = F.lit(8 * words)
    for i in range(words):
        x = a[i].bitwiseXOR(b[i])
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _differing(a: Column, b: Column, words: int) -> Column:
    """Number of differing bits of the parity bitmaps that follow so many longs of a sketch."""
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words, words + PARITY // 64)), F.lit(0))


def _candidates(left: DataFrame, right: DataFrame, matches: int, percent: int, words: int, once: bool = False) -> DataFrame:
    """Distinct (a, b, hits) of two posting tables (pair, node, n, sketch, label): different components, near sizes, enough agreement.

    ``once``: ``left`` is the part of ``right`` that is not ``main``; of two such members only the smaller meets the other,
    under the first pair that both post (``before`` has a node's smaller pairs), so every (a, b) is made once.
    """
    l, r = left.alias("l"), right.alias("r")
    hits = _agreeing(F.col("l.sketch"), F.col("r.sketch"), words)
    near = (F.col("l.label") != F.col("r.label")) & _near_size(F.col("l.n"), F.col("r.n"), percent)
    # similarity >= p/100 means at most (100 - p) / (100 + p) of both sizes differ
    unlike = _differing(F.col("l.sketch"), F.col("r.sketch"), words)
    if once:
        near &= F.col("r.main") | (F.col("l.node") < F.col("r.node"))
    near &= unlike * (100 + percent) <= (F.col("l.n") + F.col("r.n")) * (100 - percent)
    near &= hits >= matches
    if once:
        near &= ~F.arrays_overlap("l.before", "r.before")
    both = l.join(r, (F.col("l.pair") == F.col("r.pair")) & near).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), hits.alias("hits"))
    return both if once else both.distinct()


def _mixed(posted: DataFrame, label: DataFrame | None, profiles: DataFrame, before: bool = False) -> DataFrame:
    """Postings of those pairs that more than one component posts, with the component, size and sketch of their node.

    ``main`` marks the rows of the component that posts most nodes under a pair.
    ``before``: each row also has the smaller pairs of its node, of those returned; all pairs that two components share are.
    Sizes and sketches (``profiles``) join last: what is shuffled before is ids only.
    """
    if label is None:
        rows = posted.withColumn("label", F.col("node")).withColumn("main", F.lit(False))
    else:
        placed = posted.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = placed.groupBy("pair", "label").agg(F.count(F.lit(1)).alias("f"))
        split = sizes.groupBy("pair").agg(F.max(F.struct("f", "label"))["label"].alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        rows = placed.join(split.select("pair", "most"), "pair").withColumn("main", F.col("label") == F.col("most")).drop("most")
    if not before:
        return rows.join(profiles, "node")
    # at most as many as a signature has coordinates
    by_node = rows.groupBy("node", "label").agg(F.array_sort(F.collect_list(F.struct("pair", "main"))).alias("own")).join(profiles, "node")
    each = by_node.select("*", F.posexplode("own").alias("i", "at"))
    return each.select("node", "label", "n", "sketch", "at.pair", "at.main", F.slice("own.pair", F.lit(1), F.col("i")).alias("before"))


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough, computed from the whole texts."""
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    names = nodes.select("node", F.coalesce("first_id", F.lit(NO_ID)).alias("id"), F.col("first_th").alias("th"))
    rows = pairs.select("a", "b")
    for side in ("a", "b"):
        rows = rows.join(names.select(F.col("node").alias(side), F.col("id").alias(f"i{side}"), F.col("th").alias(f"h{side}")), side)
    rows = stored(rows, "asked")
    parts = rows
    for side in ("a", "b"):
        # only the texts of this side's nodes are shuffled, once: their ids are sent to the scan while they are few
        few = stored(rows.select(F.col(f"i{side}").alias("id"), F.col(f"h{side}").alias("th")).distinct(), "asked-ids")
        few = F.broadcast(few) if few.count() <= BROADCAST_IDS else few
        mine = texts.join(few, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        parts = parts.join(mine.toDF(f"i{side}", f"h{side}", f"t{side}"), [f"i{side}", f"h{side}"])
    rows = parts.select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            (oa, da), (ob, db) = utf8(batch.column("ta")), utf8(batch.column("tb"))
            for r0, r1 in row_groups(oa + ob):
                m = r1 - r0
                sides = []
                for off, data, key in ((oa, da, "a"), (ob, db, "b")):
                    row, h = shingle_sets(off[r0 : r1 + 1] - off[r0], data[off[r0] : off[r1]], k)
                    size, name = _digests(m, row, h)
                    want = batch.column(key).slice(r0, m)
                    right = np.array([x.as_py() == name[i].tobytes() for i, x in enumerate(want)], bool)
                    sides.append((row, h, size, right))
                (ra, ha, na, ga), (rb, hb, nb, gb) = sides
                row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twice], minlength=m)
                ok = ga & gb & (100 * common >= percent * (na + nb - common)) & (common > 0)
                pick = pa.array(np.flatnonzero(ok) + r0)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pick), batch.column("b").take(pick)], names=["a", "b"])

    return in_arrow(rows, run, "a binary, b binary", BATCH)


def classes_of(
    documents: DataFrame, k: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, pivots: tuple[int, ...] = PIVOTS
) -> DataFrame:
    """Per row of ``documents``: doc_id, th (hash of the text), n (set size), label (of its class; null without shingles), component_id."""
    wide = stored(features(documents, k, coordinates), "features")
    nodes = stored(
        wide.filter("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("f"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
        .select("node", F.col("f.doc_id").alias("first_id"), F.col("f.th").alias("first_th"), "n", "sig", "sketch"),
        "nodes",
    )
    rows = stored(wide.select("doc_id", "th", "n", "node"), "rows")
    discard(wide)
    posted = stored(postings(nodes, matches), "postings")
    whole, nodes = nodes, stored(nodes.drop("sig"), "names")
    discard(whole)
    profiles = nodes.select("node", "n", "sketch")

    words = coordinates // 8
    links, label = None, None
    for turn, heads in enumerate(pivots):
        rows_of_turn = stored(_mixed(posted, label, profiles), "mixed")
        drawn = Window.partitionBy("pair").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        head = rows_of_turn.withColumn("i", F.row_number().over(drawn)).filter(F.col("i") <= heads).drop("i")
        best = Window.partitionBy("a").orderBy(F.desc("hits"), "b")
        stars = _candidates(rows_of_turn, head, matches, percent, words).withColumn("i", F.row_number().over(best)).filter(F.col("i") <= TRIED)
        stars = stored(stars.select("a", "b"), "stars")
        discard(rows_of_turn)
        found = stored(verified(stars, nodes, documents, k, percent), "star-links")
        links = found if links is None else links.unionByName(found)
        label = components(links)
    rest = stored(_mixed(posted, label, profiles, before=True), "mixed")
    discard(posted)
    # of two components at least one is not the main one of a pair; its members meet all others
    across = _candidates(rest.filter("not main"), rest, matches, percent, words, once=True)
    across = stored(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "across")
    discard(rest)
    links = links.unionByName(stored(verified(across, nodes, documents, k, percent), "cross-links"))
    label = components(links)
    classes = nodes.join(label, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    ids = classes.join(smallest, "label").select("node", "label", "component_id")
    empty = rows.filter("n = 0").select("doc_id", "th", "n", F.lit(None).cast("binary").alias("label"), F.col("doc_id").alias("component_id"))
    full = rows.filter("n > 0").join(ids, "node").select("doc_id", "th", "n", "label", "component_id")
    return full.unionByName(empty)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id, kept (null-safe doc_id = component_id)."""
    return classes_of(documents, k, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each class: the smallest doc_id (then text hash); same columns.

    Rows without shingles stay; rows that repeat an id and text stay once.
    """
    rows = stored(classes_of(documents, k, percent), "classes")
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")
    first = rows.filter("label is not null").groupBy("label").agg(F.min(key).alias("first"))
    gone = (
        rows.join(first, "label")
        .filter(key != F.col("first"))
        .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("th").alias("_th"), F.lit(True).alias("_gone"))
        .distinct()
    )
    mine = documents.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_th", F.xxhash64("text"))
    again = F.row_number().over(Window.partitionBy("_id", "_th").orderBy("_id"))
    return mine.join(gone, ["_id", "_th"], "left").withColumn("_again", again).filter("_gone is null and _again = 1").select(*documents.columns)
