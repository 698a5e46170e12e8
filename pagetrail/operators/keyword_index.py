"""Stored keyword index over search documents (E1, Q2): postings per field, block maxima, top-k in two passes.

The index is a lake with four tables, all split by ``shard`` (a hash of the page id), so
replacing pages rewrites the shards of these pages only and commits all tables together:

* ``postings``  term, page_id, block, occurrences per field, length of the page's fields;
* ``blocks``    term, block: largest numbers of occurrences and smallest lengths of any page there, per field and over all, and in how many pages;
* ``lengths``   page_id, block and field lengths of every page (also of pages without any word);
* ``totals``    pages and field lengths of the shard.

A block gathers pages of one shard of about the same length, so its maxima are close to what its
pages have. BM25 rises with occurrences and falls with length, so the score of a
block's maxima bounds the score of every page in it. A search scores the pages
of the best blocks of each query first, as many as hold a few times k pages; the k-th score found is a threshold, and
of the other blocks only those whose bound reaches it are read. The result is
exact: a block that is left out holds no page above the threshold.

The numbers of shards and of blocks of one length in a shard are fixed when the
index is made; some thousand pages a block are meant, so large tables take more shards.

Fields are weighted: occurrences and lengths are summed with the fields' weights
before the BM25 formula, so weights of 1 equal BM25 over the fields taken together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import raw_tokens, token_count, tokens
from ..sources.lake import Lake, hash_bucket
from ..sources.scratch import stored
from .search import B, K1, OUT_DECIMALS, RANK_DECIMALS

FIELDS = ("title", "url", "bookmark_text")
SHARDS = 16
SPREAD = 1  # blocks of one shard and length class
CLASSES = 8  # length classes from one length to its double
FIRST = 40  # pages that the blocks scored before there is a threshold may hold, in multiples of k; fewer than k give no threshold
LITERAL_TERMS = 500  # so many query terms reach the scan as literals
SLACK = 1e-8  # scores are ranked by their rounded value

_TF = [f"tf_{f}" for f in FIELDS]
_LEN = [f"len_{f}" for f in FIELDS]


def _lengths(docs: DataFrame, shards: int, spread: int) -> DataFrame:
    """page_id, tokens of each field, field lengths, shard, block."""
    split = docs.select("page_id", *[raw_tokens(f).alias(f"_{f}") for f in FIELDS])
    counted = split.select("*", *[token_count(F.col(f"_{f}")).alias(n) for f, n in zip(FIELDS, _LEN)])
    length_class = F.floor(F.log2(F.lit(1.0) + _total(_LEN)) * CLASSES)
    apart = F.pmod(F.floor(F.col("page_id") / F.lit(shards)), F.lit(spread))
    return counted.withColumn("shard", hash_bucket("page_id", shards)).withColumn("block", (length_class * spread + apart).cast("int"))


def postings_of(counted: DataFrame) -> DataFrame:
    """term, page_id, block, occurrences and lengths per field, shard."""
    fields = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_{f}").alias("t")) for i, f in enumerate(FIELDS)])
    keep = ["page_id", "block", *_LEN, "shard"]
    words = counted.select(*keep, F.inline(fields)).select(*keep, "f", F.explode("t").alias("term")).filter("term <> ''")
    occurrences = [F.count_if(F.col("f") == i).cast("int").alias(n) for i, n in enumerate(_TF)]
    return words.groupBy("term", *keep).agg(*occurrences).select("term", "page_id", "block", *_TF, *_LEN, "shard")


def update(spark: SparkSession, base: str, docs: DataFrame, gone: DataFrame | None = None, *, shards: int = SHARDS, spread: int = SPREAD) -> Lake:
    """Put the search documents ``docs`` (page_id, title, url, bookmark_text) in place of those with the same page_id; take out pages of ``gone`` (page_id).

    ``shards`` and ``spread`` count when the index is made.
    """
    lake = Lake(spark, base)
    commit = lake.begin()
    shards, spread = commit.setting("shards", shards), commit.setting("spread", spread)
    fresh = commit.stage(docs.select("page_id", *FIELDS).dropDuplicates(["page_id"]))
    ids = fresh.select("page_id") if gone is None else fresh.select("page_id").union(gone.select("page_id")).distinct()
    touched = sorted(r[0] for r in ids.select(hash_bucket("page_id", shards)).distinct().collect())
    counted = _lengths(fresh, shards, spread)

    def merged(table: str, new: DataFrame, sort: tuple[str, ...]) -> DataFrame | None:
        old = commit.read(table, touched)
        rows = new if old is None else old.join(ids, "page_id", "left_anti").select(*new.columns).unionByName(new)
        commit.replace(table, rows, "shard", touched, sort)
        return commit.appended(table)

    postings = merged("postings", postings_of(counted), ("term", "block", "page_id"))
    lengths = merged("lengths", counted.select("page_id", "block", *_LEN, "shard"), ("page_id",))
    if postings is not None:
        maxima = [F.max(c).alias(c) for c in _TF] + [F.min(c).alias(c) for c in _LEN]
        maxima += [F.max(_total(_TF)).alias("tf"), F.min(_total(_LEN)).alias("len"), F.count(F.lit(1)).alias("df")]
        blocks = postings.groupBy("term", "block", "shard").agg(*maxima)
        commit.replace("blocks", blocks.select("term", "block", *_TF, *_LEN, "tf", "len", "df", "shard"), "shard", touched, ("term", "block"))
    elif commit.read("blocks", touched) is not None:
        commit.replace("blocks", commit.read("blocks", touched).limit(0), "shard", touched)
    if lengths is not None:
        sums = lengths.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in _LEN])
        commit.replace("totals", sums.select("n", *_LEN, "shard"), "shard", touched)
    elif commit.read("totals", touched) is not None:
        commit.replace("totals", commit.read("totals", touched).limit(0), "shard", touched)
    commit.publish()
    return lake


def _total(names: list[str]) -> Column:
    return reduce(Column.__add__, map(F.col, names))


def _weighted(names: list[str], weights: tuple[float, ...]) -> Column:
    return reduce(Column.__add__, [F.col(n) * F.lit(float(w)) for n, w in zip(names, weights)])


def search(
    lake: Lake,
    queries: DataFrame,
    *,
    k: int = 10,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    k1: float = K1,
    b: float = B,
    require_all: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The k best pages of each query (qid, text), and what was read for it.

    Hits: qid, page_id, rank, score. Report: qid, blocks (that hold candidates), blocks_read.
    """
    spark = lake.spark
    empty = spark.createDataFrame([], "qid long, page_id long, rank int, score double"), spark.createDataFrame([], "qid long, blocks long, blocks_read long")
    totals, blocks, postings = lake.read("totals"), lake.read("blocks"), lake.read("postings")
    if totals is None or blocks is None or postings is None:
        return empty
    sums = totals.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _LEN]).first()  # one row a shard
    pages, average = sums.n, sum(w * sums[c] for w, c in zip(weights, _LEN)) / sums.n

    qterms = stored(queries.select("qid", F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct(), "query_terms")
    wanted = qterms.groupBy("qid").agg(F.count(F.lit(1)).alias("n_terms"))
    few = qterms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()
    if len(few) <= LITERAL_TERMS:  # tables are sorted by term, so row groups without them are skipped
        literal = F.col("term").isin([r.term for r in few])
        blocks, postings = blocks.filter(literal), postings.filter(literal)

    def part_score(block: bool = False) -> Column:
        """Score of a term in a page, or at most in any page of a block."""
        tf, length = _weighted(_TF, weights), _weighted(_LEN, weights)
        if block:
            tf, length = F.least(tf, F.col("tf") * F.lit(float(max(weights)))), F.greatest(length, F.col("len") * F.lit(float(min(weights))))
        return F.col("idf") * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / F.lit(average)))

    df = blocks.groupBy("term").agg(F.sum("df").alias("_df"))
    idf = F.log(F.lit(1.0) + (F.lit(pages) - F.col("_df") + F.lit(0.5)) / (F.col("_df") + F.lit(0.5)))
    rated = stored(qterms.join(df, "term").select("qid", "term", idf.alias("idf")), "rated_terms")

    held = (F.min if require_all else F.max)("df").alias("held")  # as many pages as the block may have for the query, or more
    bounds = blocks.join(rated, "term").groupBy("qid", "shard", "block").agg(F.sum(part_score(block=True)).alias("bound"), F.count(F.lit(1)).alias("n"), held)
    if require_all:
        bounds = bounds.join(wanted, "qid").filter("n = n_terms")
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "shard", "block")
    before = F.coalesce(F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = stored(bounds.select("qid", "shard", "block", "bound", (before < F.lit(max(FIRST, 1) * int(k))).alias("early")), "block_bounds")

    def scores(chosen: DataFrame) -> DataFrame:
        """Scores of the pages of the chosen blocks (qid, shard, block)."""
        asked = chosen.select("qid", "shard", "block").join(rated, "qid")
        found = postings.join(asked, ["shard", "block", "term"]).groupBy("qid", "page_id").agg(F.sum(part_score()).alias("score"), F.count(F.lit(1)).alias("n"))
        return found.join(wanted, "qid").filter("n = n_terms").select("qid", "page_id", "score") if require_all else found.select("qid", "page_id", "score")

    best = Window.partitionBy("qid").orderBy(F.round("score", RANK_DECIMALS).desc(), "page_id")
    first = stored(scores(ranked.filter("early")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= int(k)), "first_pass")
    threshold = first.filter(F.col("rank") == int(k)).select("qid", F.col("score").alias("least"))
    reach = F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)
    rest = stored(ranked.filter("not early").join(threshold, "qid", "left").filter(reach).select("qid", "shard", "block"), "blocks_above")
    both = first.select("qid", "page_id", "score").unionByName(scores(rest))
    hits = both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= int(k))
    used = ranked.filter("early").select("qid").unionByName(rest.select("qid")).groupBy("qid").agg(F.count(F.lit(1)).alias("blocks_read"))
    report = ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("blocks")).join(used, "qid")
    return hits.select("qid", "page_id", "rank", F.round("score", OUT_DECIMALS).alias("score")), report
