"""Search: exact (Q1), BM25 keyword (Q2), exact k-NN (Q3), hybrid (Q4), inverted file (Q5).

Ranking rules shared with the SQL checks:
* BM25: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75; all
  query terms required by default; rank by score rounded to 9 decimals desc,
  then id asc.
* k-NN: float32 storage, float64 arithmetic; L2 (default) or cosine distance;
  rank by distance rounded to 9 decimals asc, then id asc.
* Hybrid: reciprocal rank fusion, sum of w / (60 + rank) over both lists.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.urls import with_canonical_url
from ..session import ship_package
from ..sources.scratch import discard, stored
from . import ivf
from .documents import doc_tokens
from .nearest import Best, matrix

K1 = 1.2
B = 0.75
RRF_K = 60
RANK_DECIMALS = 9
OUT_DECIMALS = 6
QUERY_BLOCK = 65_536  # query vectors a task holds at once
VECTOR_PART = 262_144  # vectors a task holds at once
LEAST_PART = 1_024  # vectors worth a task
DOC_PART = 2_048  # documents whose term counts a task gathers at once
LEAST_DOCS = 256  # documents worth a task
BROADCAST_TERMS = 100_000  # query terms that are sent to every task; a few MB
SIEVE_KEYS = 16  # keys of a block of a sieve, which has a bit of each in each of its words
SIEVE_WORDS = 4
SIEVE_BYTES = 32 << 20  # of a sieve that is sent to every task
MARKER = " "


def _top_k(df: DataFrame, group: str, order: list, k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= int(k))


# --- Q1 -----------------------------------------------------------------------------------


def exact(queries: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonicalise query URLs and equi-join them to pages on the canonical URL."""
    q = with_canonical_url(queries, url_col, "_canonical").filter(F.col("_canonical").isNotNull())
    p = pages.select(F.col("url").alias("_canonical"), "page_id", F.col("title").alias("page_title"), "host")
    return q.join(p, "_canonical").withColumnRenamed("_canonical", "canonical_url")


def exact_title(queries: DataFrame, pages: DataFrame, title_col: str = "title") -> DataFrame:
    """Pages whose stored title equals the query title (after the same clean-up as on ingest)."""
    from ..functions.text import clean_title

    q = queries.withColumn("_t", clean_title(title_col))
    return q.join(pages.select(F.col("title").alias("_t"), "page_id", "url", "host"), "_t").drop("_t")


def exact_host(queries: DataFrame, pages: DataFrame, host_col: str = "host") -> DataFrame:
    """Pages on the query host (lower-cased, surrounding whitespace and trailing dots removed)."""
    from ..functions.text import py_strip

    q = queries.withColumn("_h", F.regexp_replace(F.lower(py_strip(host_col)), r"\.+$", ""))
    return q.join(pages.select(F.col("host").alias("_h"), "page_id", "url", F.col("title").alias("page_title")), "_h").drop("_h")


# --- Q2 -----------------------------------------------------------------------------------


def bm25(
    docs: DataFrame,
    queries: DataFrame,
    *,
    id_col: str,
    text_cols: list[str],
    k: int = 10,
    k1: float = K1,
    b: float = B,
    require_all: bool = True,
) -> DataFrame:
    """Top-k documents per query: qid, doc_id, rank, score.

    ``queries``: (qid, text). The text is scanned and tokenised once: one aggregate
    (occurrences of query terms, and one marker row per document that carries
    its length) is stored, and corpus statistics, document frequencies and scores
    are taken from it. Documents that cannot differ in score (copies, for one) are scored once, and
    so are queries of the same terms. Where all terms are required, the documents that hold a query's
    two rarest terms are its candidates, and only their other terms are looked up.

    The stored aggregate is about as large as the text. Where all terms are required no step shuffles it whole: sieves leave
    the rows of the terms or documents asked for. Every step's shuffle files, and tables that no later step reads, are deleted.
    """
    spark = queries.sparkSession
    terms_of = queries.select("qid", F.array_sort(F.array_distinct(tokens("text"))).alias("terms")).filter(F.size("terms") > 0)
    asked = stored(terms_of.select("qid", "terms", *_fingerprint("terms")), "queries")
    alike = asked.groupBy("f1", "f2").agg(F.min("qid").alias("rep"))
    qterms = stored(asked.join(alike, F.col("qid") == F.col("rep"), "left_semi").select("qid", F.explode("terms").alias("term")), "query_terms")
    nterms = qterms.groupBy("qid").agg(F.count(F.lit(1)).alias("n_terms"))
    # a task that counts holds an entry for every term of each of its documents, so documents are dealt into parts of about as many rows;
    # all rows of a document are in one part, so counts are not shuffled for their sum
    n_rows = docs.count()
    parts = max(1, -(-n_rows // DOC_PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // LEAST_DOCS)))
    t = doc_tokens(docs.select(id_col, *text_cols).repartition(parts, id_col), id_col, text_cols)
    # every document emits a marker (a space, never a token) besides its tokens
    marked = t.select("doc_id", "doc_len", F.explode(F.concat(F.array(F.lit(MARKER)), "tokens")).alias("term")).filter("term <> ''")
    terms = stored(qterms.select("term").union(spark.range(1).select(F.lit(MARKER).alias("term"))).distinct(), "terms")
    counts = lambda rows: rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))
    if terms.count() <= BROADCAST_TERMS:
        counted = counts(marked.join(F.broadcast(terms), "term"))
    else:  # a common term is one row a document here, not one for every occurrence; the few rows of other terms do no harm
        counted = _sifted(counts(marked), terms, ["term"])
    # in the order of documents, whose id and length then take no room
    counted = stored(counted.select("doc_id", "term", "tf", "doc_len").sortWithinPartitions("doc_id"), "term_counts")
    marker = F.col("term") == F.lit(MARKER)
    # documents with the same counts of query terms and the same length score alike: one of them is scored
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "term", "tf")).alias(f"f{i}") for i in (1, 2)]
    members = stored(counted.groupBy("doc_id").agg(*sums, F.first("doc_len").alias("doc_len")), "documents")
    n_docs, avgdl = members.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    if not n_docs:
        return spark.createDataFrame([], "qid long, doc_id long, rank int, score double")
    idf = F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    frequency = counted.filter(~marker).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rated = stored(qterms.join(frequency, "term").select("qid", "term", "df", idf.alias("idf")), "rated_terms")
    same = ["f1", "f2", "doc_len"]
    reps = members.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    scored_ids = reps.select(F.col("rep").alias("doc_id"))
    tf = counted.filter(~marker)
    tfn = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_len") / F.lit(avgdl or 1.0)))
    if require_all:
        candidates = _candidates(rated, nterms, tf, scored_ids)
        wanted = candidates.join(rated.drop("df"), "qid")
        theirs = _sifted(tf, wanted, ["doc_id", "term"], candidates.select("doc_id").distinct().count())
        pairs = wanted.repartition(parts, "doc_id", "term").join(theirs.repartition(parts, "doc_id", "term"), ["doc_id", "term"])
    else:
        pairs = tf.join(scored_ids, "doc_id", "left_semi").join(rated, "term")
    scored = pairs.groupBy("qid", "doc_id").agg(F.sum(F.col("idf") * tfn).alias("score"), F.count(F.lit(1)).alias("n_hit"))
    if require_all:
        scored = scored.join(nterms, "qid").filter(F.col("n_hit") == F.col("n_terms")).drop("n_terms")
    order = [F.round("score", RANK_DECIMALS).desc(), F.col("doc_id")]
    best = stored(_top_k(scored, "qid", order, k).select("qid", F.col("doc_id").alias("rep"), "score"), "best_documents")
    for done in [terms, qterms, counted, rated, *([candidates] if require_all else [])]:
        discard(done)
    # the k best of all documents lie among the k smallest ids of each of the k best alike; then every query with the same terms
    some = members.join(reps, same).join(best.select("rep").distinct(), "rep")
    some = _top_k(some.select("rep", "doc_id"), "rep", [F.col("doc_id")], k, "_i").select("rep", "doc_id")
    ranked = _top_k(best.join(some, "rep"), "qid", order, k).select(F.col("qid").alias("rep"), "doc_id", "rank", F.round("score", OUT_DECIMALS).alias("score"))
    everyone = asked.join(alike, ["f1", "f2"]).select("qid", "rep")
    return everyone.join(ranked, "rep").select("qid", "doc_id", "rank", "score")


def _candidates(rated: DataFrame, nterms: DataFrame, tf: DataFrame, among: DataFrame) -> DataFrame:
    """(qid, doc_id): the documents of ``among`` that hold the two rarest terms of a query whose terms all occur somewhere."""
    complete = rated.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(nterms, "qid").filter("n = n_terms")
    rarest = _top_k(rated.join(complete, "qid", "left_semi").select("qid", "term", "df"), "qid", [F.col("df"), F.col("term")], 2, "nth")
    both = rarest.groupBy("qid").agg(F.min_by("term", "nth").alias("term"), F.max_by("term", "nth").alias("next"))  # one and the same where there is one only
    both = stored(both, "rarest_terms")
    either = both.select("term").union(both.select("next")).distinct()
    rows = stored(_sifted(tf, either, ["term"]).select("doc_id", "term"), "rarest_counts")
    first = rows.join(both, "term").select("qid", "doc_id", "next").join(among, "doc_id")
    second = rows.withColumnRenamed("term", "next")
    found = stored(first.join(second, ["doc_id", "next"], "left_semi").select("qid", "doc_id"), "candidates")
    for done in (both, rows):
        discard(done)
    return found


def _sifted(rows: DataFrame, keys: DataFrame, columns: list[str], blocks: int | None = None) -> DataFrame:
    """All rows whose ``columns`` are among those of ``keys``, and a few others: a blocked Bloom filter that is sent to every task.

    The first column gives the block of a key. There are blocks for ``SIEVE_KEYS`` keys each, or so many as given, and
    never more than may be sent; a filter of too many keys lets more of the other rows pass.
    """
    blocks = max(1, min(-(-keys.count() // SIEVE_KEYS) if blocks is None else blocks, SIEVE_BYTES // (8 * (SIEVE_WORDS + 1))))
    block = F.pmod(F.xxhash64(columns[0]), F.lit(blocks))
    places = [F.shiftright(F.xxhash64(F.lit(1), *columns), 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(SIEVE_WORDS)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places]
    words = [f"_w{i}" for i in range(SIEVE_WORDS)]
    sieve = keys.groupBy(block.alias("_block")).agg(*[F.bit_or(bit).alias(w) for w, bit in zip(words, bits)])
    held = reduce(Column.__and__, [F.col(w).bitwiseAND(bit) != 0 for w, bit in zip(words, bits)])
    return rows.withColumn("_block", block).join(F.broadcast(sieve), "_block").filter(held).select(*rows.columns)


def _fingerprint(column: str) -> list:
    """128 bits that stand for the value of a column."""
    return [F.xxhash64(F.lit(i), column).alias(f"f{i}") for i in (1, 2)]


# --- Q3 -----------------------------------------------------------------------------------


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    metric: str = "l2",
    id_col: str = "page_id",
    vec_col: str = "embedding",
    q_vec_col: str = "vector",
) -> DataFrame:
    """Exact k nearest vectors per query: qid, doc_id, rank, distance.

    A join of two distributed tables in blocks: vectors are dealt into parts of
    at most about ``VECTOR_PART`` rows and queries into blocks of at most about ``QUERY_BLOCK``, both by hash;
    every part meets every block in one task, which keeps the k best of each
    query of its block. A per-query top-k picks the global winners. Neither
    table passes through the driver.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vec_col).alias("embedding"))
    q = queries.select(F.col("qid").cast("long").alias("qid"), F.col(q_vec_col).alias("vector"))
    n, m, sizes = v.count(), *q.agg(F.count(F.lit(1)), F.collect_set(F.size("vector"))).first()
    if len(sizes) > 1:
        raise ValueError(f"query vectors have different dimensions: {sorted(sizes)[:5]}")
    if not n or not m:
        return spark.createDataFrame([], "qid long, doc_id long, rank int, distance double")
    parts, blocks = _grid(n, m, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_PART)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = v.withColumn("part", F.pmod(F.xxhash64("doc_id", "embedding"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    right = q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def meet(_, mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        best = Best(matrix(asked["vector"], asked["qid"]), int(k), metric, RANK_DECIMALS)
        best.add(matrix(mine["embedding"], mine["doc_id"], best.queries.shape[1]), mine["doc_id"].to_numpy())
        return pa.table({"qid": asked["qid"].to_numpy()[best.row], "doc_id": best.id, "distance": best.distance})

    cands = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "qid long, doc_id long, distance double")
    ranked = _top_k(cands, "qid", [F.col("distance"), F.col("doc_id")], k)
    return ranked.select("qid", "doc_id", "rank", F.round("distance", OUT_DECIMALS).alias("distance"))


def _grid(n: int, m: int, tasks: int) -> tuple[int, int]:
    """Parts of ``n`` vectors and blocks of ``m`` queries: at least ``tasks`` pairs of them, with the fewest rows to shuffle, as every block takes all vectors once and every part all queries."""
    least, blocks = -(-n // VECTOR_PART), -(-m // QUERY_BLOCK)
    pairs = max(least, tasks) * blocks
    grids = [(max(least, -(-pairs // b)), b) for b in range(blocks, min(m, blocks + math.isqrt(pairs)) + 1)]
    return min(grids, key=lambda g: n * g[1] + m * g[0])


def centroids(vectors: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Per-group mean vector (qid = group), aggregated element-wise with a partial step."""
    e = vectors.select(F.col(group_col).cast("long").alias("qid"), F.posexplode(vec_col).alias("pos", "x"))
    per_dim = e.groupBy("qid", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return per_dim.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector")
    )


# --- Q4 -----------------------------------------------------------------------------------


def hybrid(keyword_hits: DataFrame, vector_hits: DataFrame, *, k: int = 10, w_keyword: float = 1.0, w_vector: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists on (qid, doc_id)."""
    kw = keyword_hits.select("qid", "doc_id", F.col("rank").alias("kw_rank"))
    vv = vector_hits.select("qid", "doc_id", F.col("rank").alias("vec_rank"))
    j = kw.join(vv, ["qid", "doc_id"], "full_outer")
    score = F.coalesce(F.lit(w_keyword) / (F.lit(RRF_K) + F.col("kw_rank")), F.lit(0.0)) + F.coalesce(
        F.lit(w_vector) / (F.lit(RRF_K) + F.col("vec_rank")), F.lit(0.0)
    )
    fused = j.withColumn("rrf", score)
    ranked = _top_k(fused, "qid", [F.round("rrf", RANK_DECIMALS).desc(), F.col("doc_id")], k)
    return ranked.select("qid", "doc_id", "rank", "kw_rank", "vec_rank", F.round("rrf", OUT_DECIMALS).alias("score"))


# --- Q5 -----------------------------------------------------------------------------------


def ann(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    share: float = 0.2,
    cells: int | None = None,
    id_col: str = "page_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Approximate k-NN: an inverted file over all vectors (see ``ivf``), of which a query sees the nearest cells up to ``share``."""
    index = ivf.build(vectors, id_col=id_col, vec_col=vec_col, cells=cells)
    ranked = _top_k(ivf.search(index, queries, k=k, share=share), "qid", [F.col("distance"), F.col("doc_id")], k)
    return ranked.select("qid", "doc_id", "rank", F.round("distance", OUT_DECIMALS).alias("distance"))


def recall_at_k(approx: DataFrame, exact_hits: DataFrame) -> DataFrame:
    """Share of exact top-k ids found by the approximate search, per query."""
    hit = exact_hits.select("qid", "doc_id").join(approx.select("qid", "doc_id").withColumn("f", F.lit(1)), ["qid", "doc_id"], "left")
    return hit.groupBy("qid").agg((F.count("f") / F.count(F.lit(1))).alias("recall"))
