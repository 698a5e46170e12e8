"""Benchmark decontamination with spaced seeds; DataFrame functions only.

Texts become words (runs of letters and digits, lower-cased; in scripts written
without spaces every letter is a word). A fixed mask laid
over the words at every position hashes the words under its ones and ignores
those under its zeros, so a seed survives substitutions there. The masks are
chosen by the number of words that must agree: whichever words are substituted,
within the share that is allowed, one mask has all its ones on equal words, so
no alignment that counts lacks a hit. Seeds of the
documents are joined to the seeds of the benchmark; a hit names a document, an
item and a diagonal (position in the document minus position in the item).
Every diagonal with a hit is verified on the words themselves: a document is
contaminated by an item if, on such a diagonal, some ``window`` words of the item (all of a shorter
one) have at least ``percent`` of their words at the same places of the
document. Items of any length are judged, and one of fewer than five words must
stand there whole; items without any word find nothing.

The benchmark's seeds are broadcast only if their measured number is within
``BROADCAST_WORDS``; beyond that the same join is left to a shuffle. Words are
hashed once each, and masks hash those hashes; equal words always give equal
seeds, and what a hit names is compared by the words. Hits of a
document are summed before they are shuffled. The whole text is scanned.

Rows: null and empty texts have no words and are clean; rows that share a
``doc_id`` are judged by their own texts; repeated rows give one result; an
empty benchmark finds nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
PERCENT = 80
# (fewest words, masks): with at most a fifth of the words substituted no pattern escapes, from here to the next entry or PROVEN words
MASKS_FROM = (
    (1, ("1",)),
    (2, ("11",)),
    (3, ("111",)),
    (4, ("1111",)),
    (5, ("1011", "111")),
    (6, ("100111", "11101")),
    (10, ("100101011", "1110011", "110111")),
    (15, ("11010010011", "1110111", "10110100011")),
)
MASKS = tuple(m for _, masks in MASKS_FROM for m in masks)
PROVEN = 20
BROADCAST_WORDS = 500_000  # words of the benchmark; their seeds take less than 64 MB
PIECE = 1_000  # word positions whose seeds are made from one array of hashes
NO_ID = -(2**63)
# letters of scripts without spaces between words, all from U+0E00 on; the two long-vowel marks belong to no script
UNSPACED = (
    r"[\x{E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsYi}\x{30FC}\x{FF70}\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
    r"\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}]&&[\p{L}\p{N}]]"
)


def words(text: Column) -> Column:
    """Array of the text's words; empty for a null or wordless text."""
    apart = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $0 ")
    return F.array_remove(F.split(apart, r"[^\p{L}\p{N}]+"), "")


def masks_for(length: int, percent: int = PERCENT) -> tuple[str, ...]:
    """Masks of which one, at some place, has its ones on equal words only, whichever ``percent`` of ``length`` words are equal."""
    wrong = length * (100 - percent) // 100
    if length <= PROVEN and 5 * wrong <= length:
        return next((masks for least, masks in reversed(MASKS_FROM) if least <= length), ())
    return ("1" * max(1, -(-(length - wrong) // (wrong + 1))),)  # the longest run that so many substitutions cannot break


def _seed_rows(df: DataFrame, masks: tuple[str, ...], *keep: str, fits: list[Column] | None = None) -> DataFrame:
    """One row per seed: the kept columns, position and hash.

    Every mask is laid at every word position where it ends within the words and fits the row. Words are hashed once each;
    positions and masks are rows made from short pieces of those hashes, in generated code rather than in a lambda over the words.
    """
    n, least, span = F.size("w"), min(map(len, masks)), max(map(len, masks))
    fits = fits or [F.lit(True)] * len(masks)
    hashed = df.select(*keep, *[f.alias(f"_fits{k}") for k, f in enumerate(fits)], F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    pieces = hashed.select("*", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least, F.lit(PIECE)))).alias("_from"))
    pieces = pieces.withColumn("w", F.slice("w", F.col("_from") + 1, PIECE + span - 1))
    last = F.least(n - least, F.lit(PIECE - 1))  # of the piece's own positions; the words beyond them belong to the next piece
    at = pieces.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    i = F.col("_at")
    found = [
        F.when(F.col(f"_fits{k}") & (i + len(mask) <= n), F.xxhash64(F.lit(k), *[F.get("w", i + o) for o, c in enumerate(mask) if c == "1"]))
        for k, mask in enumerate(masks)
    ]
    return at.select(*keep, (F.col("_from") + i).alias("p"), F.explode(F.array(*found)).alias("seed")).filter("seed is not null")


def identified(documents: DataFrame) -> DataFrame:
    """(id, th, doc_id, text): the id without nulls and the hash of the text tell rows apart."""
    return documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """One row per contaminated document and item.

    id, th (see :func:`identified`), doc_id, item_id, n_hits (seeds on the best
    diagonal), start (document word where the item begins there), n_matched and
    n_words (words of the item, matched and all).
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    total, lengths = items.agg(F.sum(F.size("w")), F.collect_set(length)).first()  # at most ``window`` lengths
    small = F.broadcast if (total or 0) <= BROADCAST_WORDS else (lambda df: df)
    masks = tuple(sorted({m for x in lengths for m in masks_for(x, percent)})) or MASKS[:1]
    fits = [length.isin([x for x in lengths if m in masks_for(x, percent)]) for m in masks]
    docs = identified(documents)
    known = _seed_rows(items, masks, "item_id", fits=fits).withColumnRenamed("p", "q")
    hits = (
        _seed_rows(docs.select("id", "th", words(F.col("text")).alias("w")), masks, "id", "th")
        .join(small(known), "seed")
        .groupBy("id", "th", "item_id", (F.col("p") - F.col("q")).alias("start"))
        .agg(F.count(F.lit(1)).alias("n_hits"))
    )
    found = hits.groupBy("id", "th").agg(F.collect_list(F.struct("item_id", "start", "n_hits")).alias("hit"))
    pairs = (
        docs.join(found, ["id", "th"])
        .select("id", "th", "doc_id", words(F.col("text")).alias("w"), "hit")
        .dropDuplicates(["id", "th"])
        .select("id", "th", "doc_id", "w", F.inline("hit"))
        .join(small(items.withColumnRenamed("w", "b")), "item_id")
    )
    n = F.size("b")
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda j: (F.coalesce(F.get("w", F.col("start") + j) == F.get("b", j), F.lit(False))).cast("int"))
    length = F.least(n, F.lit(window))
    add = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)
    enough = F.exists(F.sequence(F.lit(1), n - length + 1), lambda i: add(F.slice("same", i, length)) * 100 >= length * percent)
    good = pairs.withColumn("same", same).filter(enough)
    best = F.max(F.struct(add(F.col("same")).alias("n_matched"), "n_hits", (-F.col("start")).alias("back"), n.alias("n_words"))).alias("x")
    return (
        good.groupBy("id", "th", "doc_id", "item_id")
        .agg(best)
        .select("id", "th", "doc_id", "item_id", "x.n_hits", (-F.col("x.back")).alias("start"), "x.n_matched", "x.n_words")
    )


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document and item: doc_id, item_id, n_matched, n_words, overlap (share of the item's words)."""
    rows = contaminated(documents, benchmark).groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_words").alias("n_words"))
    return rows.select("doc_id", "item_id", "n_matched", "n_words", (F.col("n_matched") / F.col("n_words")).alias("overlap"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones."""
    bad = contaminated(documents, benchmark).select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    mine = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
    return documents.join(bad, mine, "left_anti")
