"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte is removed when a ``threshold``-byte string that covers it also starts
earlier in the corpus: in a document of smaller ``doc_id``, or earlier in the
same document. The full suffix array would sort every byte position in every
round (more than ten times the input in each shuffle), so the doubling is run
on a *sparse* suffix array that keeps all information needed:

1. Each window of ``threshold`` bytes is owned by one position: the start of
   the smallest (by hash, leftmost) prefix of ``threshold // 2`` bytes inside
   it. Equal windows are owned at the same relative position, and about one
   position in ``threshold // 4`` owns any window.
2. Round one ranks the owners by that half-length prefix, then by the longer
   range that their windows cover: Spark sorts (prefix, range, document,
   position). A position whose prefix is unique drops out. Later members of a
   run with the same range are repeats as a whole. Positions that share the
   prefix but not the range stay.
3. Round two doubles the offset for the windows of the positions that are
   left: the pair of names at offsets 0 and ``threshold // 2`` stands for the
   whole window. Spark sorts (pair, document, position); all but the earliest
   of equal pairs are repeats.

Names are hashes of the byte ranges, used in pairs (128 bits decide in round
one, 96 in round two).

Hot strings: the sort is a range partitioning over (prefix, range, document,
position), so rows of one hot prefix spread over partitions; positions at a
partition's edge are passed to round two. There the one row at a partition's
edge is compared with all equal windows by a broadcast join (a row for each
partition). Nothing is collected, and long texts are processed in blocks.

Rows: a null text is empty; a null ``doc_id`` sorts before all others; rows
sharing a ``doc_id`` are told apart by the CRC-32 of their text (smaller
first); identical rows are one document, so they do not make each other
repeats. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import RangeHash, U, mix
from .shared import in_arrow, stored, utf8

BLOCK = 1 << 17  # bytes of one hashing step
NO_ID = -(2**63)  # stands for a null doc_id


def _valid_starts(off: np.ndarray, lo: int, hi: int, width: int) -> np.ndarray:
    """Which of the buffer positions [lo, hi) start a window inside one document."""
    edge = np.zeros(hi - lo + 1, np.int32)
    first, last = off[:-1], off[1:] - width + 1
    keep = (last > first) & (last > lo) & (first < hi)
    np.add.at(edge, np.clip(first[keep], lo, hi) - lo, 1)
    np.add.at(edge, np.clip(last[keep], lo, hi) - lo, -1)
    return np.cumsum(edge[:-1]) > 0


def owners(off: np.ndarray, data: np.ndarray, threshold: int):
    """Per block: owning prefix name, range name, document row, first window, number of windows."""
    half = threshold // 2
    span = threshold - half + 1  # prefixes in one window
    for lo in range(0, max(0, len(data) - threshold + 1), BLOCK):
        part = data[lo : lo + BLOCK + threshold - 1]
        m = len(part) - threshold + 1
        ok = _valid_starts(off, lo, lo + m, threshold)
        if not ok.any():
            continue
        rh = RangeHash(part)
        name = rh.every(half)
        # smallest of the upper hash bits, then leftmost; both are relative to the window's content
        low = (name & U(0xFFFFFFFF00000000)) | np.arange(len(name), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        owner = (low[:m] & U(0xFFFFFFFF)).astype(np.int64)
        same = np.zeros(m + 1, bool)
        same[1:m] = (owner[1:] == owner[:-1]) & ok[1:] & ok[:-1]
        first = np.flatnonzero(ok & ~same[:-1])
        last = np.flatnonzero(ok & ~same[1:])
        count = last - first + 1
        whole = mix(rh.of(first, last + threshold) + count.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        row = np.searchsorted(off, lo + first, "right") - 1
        yield name[owner[first]], whole, row, lo + first - off[row], count


def _anchor_rows(threshold: int):
    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            ids, crc = np.asarray(b.column("doc")), np.asarray(b.column("crc"))
            for name, whole, row, start, count in owners(off, data, threshold):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(ids[row]),
                        pa.array((crc[row] << 32) | start),
                        pa.array(count.astype(np.int16)),
                    ],
                    names=["name", "whole", "doc", "at", "n"],
                )

    return run


def _rerank(batches):
    """Rows sorted by (name, whole, doc, at): repeats of a whole range, and positions left for the next round.

    Keeps one row between batches. The first and the last class of a partition
    are always left for the next round, as their neighbours may be elsewhere.
    """
    held = None  # the latest first-of-its-range row and whether its class is known to be mixed
    first_class = None

    def out(cols, pick, repeat):
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[2][pick]), pa.array(cols[3][pick]), pa.array(cols[4][pick]), pa.array(np.full(len(pick), repeat))],
            names=["doc", "at", "n", "repeat"],
        )

    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [np.asarray(b.column(i)) for i in range(5)]
        if held is None:
            first_class, before = cols[0][0], True
        else:
            cols, before = [np.concatenate([h, c]) for h, c in zip(held[0], cols)], held[1]
        name, whole, doc, at, _ = cols
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (whole[1:] != whole[:-1])
        lead = np.flatnonzero(fresh)
        head = lead[np.cumsum(fresh) - 1]
        again = np.flatnonzero(~fresh & ((doc != doc[head]) | (at != at[head])))
        if len(again):
            yield out(cols, again, True)
        mixed = np.zeros(len(lead) + 1, bool)
        mixed[0] = before
        mixed[1:-1] = name[lead[1:]] == name[lead[:-1]]
        left = (mixed[:-1] | mixed[1:]) | (name[lead] == first_class)
        left = lead[:-1][left[:-1]]
        if len(left):
            yield out(cols, left, False)
        held = [c[lead[-1:]] for c in cols], bool(mixed[-2])
    if held is not None:
        yield out(held[0], np.zeros(1, np.int64), False)


def _window_rows(threshold: int):
    """Names of the windows of the positions that are left: the pair at offsets 0 and half, twice hashed."""
    half = threshold // 2

    def run(batches):
        for b in batches:
            off, data = utf8(b.column("text"))
            ids, crc = np.asarray(b.column("doc")), np.asarray(b.column("crc"))
            spots, stops = b.column("at"), b.column("n")
            so = np.asarray(spots.offsets).astype(np.int64)
            start = np.asarray(spots.values)[so[0] : so[-1]] & 0xFFFFFFFF
            count = np.asarray(stops.values)[so[0] : so[-1]].astype(np.int64)
            row_of = np.repeat(np.arange(b.num_rows), np.diff(so))
            for r in range(b.num_rows):
                mine = slice(*np.searchsorted(row_of, [r, r + 1]))
                s, c = start[mine], count[mine]
                order = np.argsort(s, kind="stable")
                s, c = s[order], c[order]
                text = data[off[r] : off[r + 1]]
                done = 0
                while done < len(s):  # positions whose windows lie in one block
                    base = int(s[done])
                    stop = max(done + 1, int(np.searchsorted(s, base + BLOCK)))
                    until = int((s[done:stop] + c[done:stop]).max()) + threshold
                    part = text[base:until]
                    w = np.repeat(s[done:stop] - base, c[done:stop])
                    w = w + np.arange(len(w)) - np.repeat(np.cumsum(c[done:stop]) - c[done:stop], c[done:stop])
                    pair = []
                    for seed in (1, 2):
                        rh = RangeHash(part, seed)
                        pair.append(mix(rh.of(w, w + half) * U(3) + rh.of(w + half, w + threshold)).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair[0]), pa.array((pair[1] >> 32).astype(np.int32)), pa.array(np.full(len(w), ids[r])), pa.array((crc[r] << 32) | (w + base))],
                        names=["k1", "k2", "doc", "at"],
                    )
                    done = stop

    return run


def _later(batches):
    """Rows sorted by (k1, k2, doc, at): all but the earliest of equal pairs; the partition's first row is marked as its edge."""
    head = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [np.asarray(b.column(i)) for i in range(4)]
        if head is None:
            yield pa.RecordBatch.from_arrays([*(pa.array(c[:1]) for c in cols), pa.array([True])], names=["k1", "k2", "doc", "at", "edge"])
        else:
            cols = [np.concatenate([h, c]) for h, c in zip(head, cols)]
        k1, k2, doc, at = cols
        fresh = np.ones(len(k1), bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        lead = np.flatnonzero(fresh)
        first = lead[np.cumsum(fresh) - 1]
        pick = np.flatnonzero((doc != doc[first]) | (at != at[first]))
        if len(pick):
            yield pa.RecordBatch.from_arrays([*(pa.array(c[pick]) for c in cols), pa.array(np.zeros(len(pick), bool))], names=["k1", "k2", "doc", "at", "edge"])
        head = [c[lead[-1:]] for c in cols]


def repeats(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """Repeated windows as (doc, at, n): n windows from the position in the low 32 bits of ``at``.

    ``docs`` has (doc, crc, text) as made by :func:`keyed`.
    """
    if threshold < 4:
        raise ValueError("threshold must be at least 4 bytes")
    anchors = in_arrow(docs, _anchor_rows(threshold), "name long, whole long, doc long, at long, n short")
    order = ["name", "whole", "doc", "at"]
    ranked = anchors.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = stored(in_arrow(ranked, _rerank, "doc long, at long, n short, repeat boolean"), "reranked")
    left = (
        ranked.filter(~F.col("repeat"))
        .groupBy("doc", F.shiftright("at", 32).alias("crc"))
        .agg(F.collect_list(F.struct("at", "n")).alias("spots"))
        .select("doc", "crc", F.col("spots.at").alias("at"), F.col("spots.n").alias("n"))
    )
    windows = docs.join(left, ["doc", "crc"]).select("doc", "crc", "text", "at", "n")
    windows = stored(in_arrow(windows, _window_rows(threshold), "k1 long, k2 int, doc long, at long"), "windows")
    order = ["k1", "k2", "doc", "at"]
    sorted_windows = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    later = stored(in_arrow(sorted_windows, _later, "k1 long, k2 int, doc long, at long, edge boolean"), "repeated-windows")
    edge = F.broadcast(later.filter("edge").select("k1", "k2", F.col("doc").alias("edge_doc"), F.col("at").alias("edge_at")))  # one row a partition
    earlier = (F.col("doc") < F.col("edge_doc")) | ((F.col("doc") == F.col("edge_doc")) & (F.col("at") < F.col("edge_at")))
    edge = windows.join(edge, ["k1", "k2"]).filter(earlier).select(F.col("edge_doc").alias("doc"), F.col("edge_at").alias("at")).distinct()
    later = later.filter("not edge").select("doc", "at").unionByName(edge).withColumn("n", F.lit(1).cast("short"))
    return ranked.filter("repeat").select("doc", "at", "n").unionByName(later)


def keyed(documents: DataFrame) -> DataFrame:
    """(doc, crc, text): the id with null as the smallest, 31 bits of the text's CRC-32, and the text without nulls."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.shiftright(F.crc32(F.encode(text, "UTF-8")), 1).alias("crc"),
        text.alias("text"),
    )


def _merged(starts: np.ndarray, counts: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Maximal removed runs [start, end) of windows given by first start and number."""
    if len(starts) == 0:
        return []
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + counts - 1 + threshold)[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return list(zip(s[new].tolist(), e[last].tolist()))


def removed_runs(documents: DataFrame, threshold: int = 100) -> DataFrame:
    """(doc, crc, at array, n array): the repeated windows of every document that has any."""
    found = repeats(keyed(documents), threshold)
    return (
        found.groupBy("doc", F.shiftright("at", 32).alias("crc"))
        .agg(F.collect_list(F.struct("at", "n")).alias("spots"))
        .select("doc", "crc", F.col("spots.at").alias("at"), F.col("spots.n").alias("n"))
    )


def _each(b: pa.RecordBatch, threshold: int):
    """(row, text bytes, removed runs) of a batch with text, at and n."""
    off, data = utf8(b.column("text"))
    at, n = b.column("at"), b.column("n")
    for r in range(b.num_rows):
        body = data[off[r] : off[r + 1]]
        if not at[r].is_valid:
            yield r, body, []
            continue
        starts = np.asarray(at[r].values) & 0xFFFFFFFF
        yield r, body, _merged(starts, np.asarray(n[r].values).astype(np.int64), threshold)


def digests(documents: DataFrame, threshold: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for b in batches:
            rows = []
            for _, body, runs in _each(b, threshold):
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(body[at:s])
                    at = e
                kept.update(body[at:])
                rows.append((len(body), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
            n_bytes, removed, spans, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    runs = removed_runs(documents, threshold)
    rows = keyed(documents).join(runs, ["doc", "crc"], "left")
    rows = rows.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text", "at", "n")
    return in_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(body: np.ndarray, s: int, e: int) -> tuple[int, int]:
    """Shrink a run to whole UTF-8 characters."""
    while s < e and (body[s] & 0xC0) == 0x80:
        s += 1
    while e > s and e < len(body) and (body[e] & 0xC0) == 0x80:
        e -= 1
    return s, e


def without_repeats(documents: DataFrame, threshold: int = 100) -> DataFrame:
    """``documents`` with the repeated strings taken out of ``text``; same columns.

    Runs are shrunk to whole characters, so the text stays valid. ``n_chars``
    is set anew where the column exists. A row of which nothing is left but
    white space, though something was removed, is dropped; all others stay.
    """
    runs = removed_runs(documents, threshold).withColumnRenamed("at", "_at").withColumnRenamed("n", "_n")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(
        "crc", F.shiftright(F.crc32(F.encode(text, "UTF-8")), 1)
    )
    rows = rows.join(runs, ["doc", "crc"], "left").drop("doc", "crc")
    clean = rows.filter("_at is null").drop("_at", "_n")
    cut = rows.filter("_at is not null")
    names = documents.columns

    def run(batches):
        for b in batches:
            view = pa.RecordBatch.from_arrays([b.column("text"), b.column("_at"), b.column("_n")], names=["text", "at", "n"])
            texts = []
            for _, body, found in _each(view, threshold):
                parts, at = [], 0
                for s, e in found:
                    s, e = _whole_characters(body, s, e)
                    parts.append(body[at:s].tobytes())
                    at = e
                parts.append(body[at:].tobytes())
                texts.append(b"".join(parts).decode("utf-8", "replace"))
            keep = pa.array([bool(t.strip()) for t in texts], pa.bool_())
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    out = clean.unionByName(in_arrow(cut, run, documents.schema))
    if "n_chars" in names:
        kind = dict(documents.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out
