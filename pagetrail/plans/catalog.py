"""Registered queries over the given tables: name -> (spark, sf_dir) -> DataFrame.

Each query runs the library's operators over whole derived tables; the
parameters below are the configuration a user would pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, embed, history, ingest, integrity, policy, search
from ..sources import tables as tb

# The query configuration shared with the SQL checks.
RULES = [
    "-*.example.org",
    "+ads-track.example.org",
    "-www.cheap-pills.example.com",
    "-m.*",
    "+m.*.example.net/en/*",
    "-*/fr/*",
    "+blog.*/fr/*",
]
RECENT_DAYS = 2
INGEST_DAYS = 7
LIMIT_PER_PROFILE = 50
MAX_ITEMS = 100
TEXT_QUERIES = [
    "the",
    "of the",
    "der und",
    "que la",
    "rewh",
    "tion ment",
    "eau",
    "ein von",
    "with this that",
    "très",
]
TOP_K = 10
EXPORT_PARTS = 8
FIELD_WEIGHTS = (2.0, 1.0, 1.5)  # title, url, bookmark text
HYBRID_DEPTH = 20
ACTIVE_MODEL = "hash-64-v2"
ACTIVE_MODEL_OF_TABLES = "model-0"

QueryFn = Callable[[SparkSession, str], DataFrame]


# --- shared derived inputs ------------------------------------------------------------------


def _visits(spark, d):
    return tb.visits(spark, d)


def _cutoff_literal(spark, d, days: float) -> int:
    """Window start as a literal: reference time resolved once on the driver."""
    return tb.as_of_literal(spark, d) - int(max(0.0, float(days)) * 86_400 * 1_000_000)


@tb.view
def _annotated_view(spark, d, days, rules: tuple):
    if days is None:
        return ingest.annotated_visit_rows(_visits(spark, d), tb.places(spark, d), None, list(rules))
    cut = _cutoff_literal(spark, d, days)
    return ingest.annotated_visit_rows(tb.visits_since(spark, d, cut), tb.places(spark, d), cut, list(rules))


def _as_of(spark, d):
    return tb.as_of_us(spark, d)


def _window_rows(spark, d, days: float | None):
    if days is None:
        return ingest.recent_visit_rows(_visits(spark, d), tb.places(spark, d), None)
    cut = _cutoff_literal(spark, d, days)
    return ingest.recent_visit_rows(tb.visits_since(spark, d, cut), tb.places(spark, d), cut)


def _annotated(spark, d, days: float | None, rules=()):
    return _annotated_view(spark, d, days, tuple(rules))


def _allowed(a: DataFrame) -> DataFrame:
    return a.filter(F.col("status") == F.lit("allowed"))


@tb.view
def ingested_pages(spark, d) -> DataFrame:
    """Pages table after one ingest of the whole history (no rules)."""
    return ingest.merge_pages(None, ingest.page_batch(_allowed(_annotated(spark, d, None))))


@tb.view
def ingested_visits(spark, d, days=None) -> DataFrame:
    """All ingested visits, or those of the last ``days``: that bound reaches the events scan, below the de-duplication."""
    return ingest.visit_batch(_allowed(_annotated(spark, d, days)))


# --- queries --------------------------------------------------------------------------------


def q_recent_visits(spark, d):
    return _window_rows(spark, d, RECENT_DAYS).select(
        "browser", "profile", "source_visit_id", "raw_url", "raw_title", "visited_at_us"
    )


def q_history_topk(spark, d):
    return history.history_entries(tb.history_snapshot(spark, d), LIMIT_PER_PROFILE)


def q_normalize_urls(spark, d):
    from ..functions.text import clean_title
    from ..functions.urls import with_canonical_url, with_url_host

    p = with_url_host(with_canonical_url(tb.places(spark, d), "url", "canonical_url"), "canonical_url", "host")
    return p.select(
        "place_id",
        "url",
        "canonical_url",
        clean_title("title").alias("title"),
        F.when(F.col("canonical_url").isNotNull(), F.col("host")).alias("host"),
    )


def q_dedupe_history(spark, d):
    return history.dedupe(history.history_entries(tb.history_snapshot(spark, d)))


def q_history_preview_input(spark, d):
    from ..functions.text import embedding_text

    e = history.preview_entries(tb.history_snapshot(spark, d), rules=RULES, max_items=MAX_ITEMS)
    return e.withColumn("embedding_input", embedding_text("title", "canonical_url"))


def q_snapshot_summary(spark, d):
    """A7 over every selected entry (O2, the cap, is ``history_preview_input``)."""
    s = tb.history_snapshot(spark, d)
    return history.snapshot_summary(s, history.preview_entries(s, rules=RULES))


def q_policy_filter(spark, d):
    """F5 over every visit."""
    a = _allowed(_annotated(spark, d, None))
    out = policy.annotate(a, "canonical_url", RULES).filter(F.col("policy_allowed"))
    return out.select(
        "browser", "profile", "source_visit_id", "canonical_url", "host", F.col("policy_rule_index").alias("rule_index")
    )


def q_policy_trace(spark, d):
    from ..functions.urls import with_canonical_url

    urls = with_canonical_url(tb.places(spark, d), "url", "cu").select(F.col("cu").alias("url"))
    urls = urls.filter(F.col("url").isNotNull()).distinct()
    return policy.check(urls, "url", RULES).select(
        "url",
        F.col("policy_host").alias("host"),
        F.col("policy_allowed").alias("allowed"),
        F.col("policy_rule_index").alias("rule_index"),
        F.col("policy_trace").alias("matched_rules"),
    )


def recent_hosts(spark, d, days: float = INGEST_DAYS) -> DataFrame:
    """Distinct hosts of recent visits (sorted on output)."""
    a = _annotated(spark, d, days)
    return a.filter(F.col("status") != F.lit("invalid")).select("host").distinct()


def q_policy_preview(spark, d):
    return policy.preview(recent_hosts(spark, d), RULES).orderBy("host")


def q_policy_preview_counts(spark, d):
    return policy.preview_counts(policy.preview(recent_hosts(spark, d), RULES))


def _older_and_newer(spark, d):
    cut = F.lit(_cutoff_literal(spark, d, INGEST_DAYS))
    a = _annotated(spark, d, None, RULES)
    allowed = _allowed(a)
    return allowed.filter(F.col("visited_at_us") < cut), allowed.filter(F.col("visited_at_us") >= cut)


def q_page_upsert(spark, d):
    old, new = _older_and_newer(spark, d)
    existing = ingest.merge_pages(None, ingest.page_batch(old))
    return ingest.merge_pages(existing, ingest.page_batch(new))


def q_incremental_merge(spark, d):
    """Older history, newer history and the newer again, merged into a lake commit by commit; its pages with their visits."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.lake import Lake
    from ..streaming import incremental

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}"
    old, new = _older_and_newer(spark, d)
    for batch in (old, new, new):
        incremental.merge_annotated(spark, batch, base, title_policy="newest")
    lake = Lake(spark, base)
    lake.vacuum(keep=1)
    pages, visits = lake.read("pages"), lake.read("visits")
    if pages is None:
        return spark.createDataFrame([], "page_id long, url string, title string, first_seen_us long, last_seen_us long, n_visits long")
    n = visits.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_visits"))
    return pages.join(n, "page_id").select("page_id", "url", "title", "first_seen_us", "last_seen_us", "n_visits")


def q_visit_insert_ignore(spark, d):
    """J5 of every visit into a table that holds the older ones."""
    old, _ = _older_and_newer(spark, d)
    return ingest.merge_visits(ingest.visit_batch(old), ingest.visit_batch(_allowed(_annotated(spark, d, None, RULES))))


def q_profile_register(spark, d):
    stores = ingest.stores_of(_visits(spark, d))
    existing = ingest.register_profiles(None, stores.filter(F.col("browser") == F.lit("zen"))).drop("is_new")
    return ingest.register_profiles(existing, stores)


def q_ingest_summary(spark, d):
    a = _annotated(spark, d, INGEST_DAYS, RULES)
    n_stores = ingest.stores_of(_visits(spark, d)).select(F.count(F.lit(1))).scalar()
    return ingest.summary(a, n_stores)


def q_search_documents(spark, d):
    return documents.search_documents(ingested_pages(spark, d), tb.bookmarks(spark, d))


def q_embedding_candidates(spark, d):
    return embed.candidates(ingested_pages(spark, d))


def q_content_hash_changes(spark, d):
    old, new = _older_and_newer(spark, d)
    before = ingest.merge_pages(None, ingest.page_batch(old))
    after = ingest.merge_pages(before, ingest.page_batch(new))
    meta = before.select("page_id", F.lit(1).cast("long").alias("model_id"), embed.content_hash().alias("content_hash"))
    return embed.hash_changes(after, meta, 1)


def q_embedding_replace(spark, d):
    v = tb.vectors(spark, d)
    fresh = v.filter(F.col("label") < 5).select("page_id", F.transform("embedding", lambda x: x * F.lit(2.0).cast("float")).alias("embedding"))
    return embed.replace_vectors(v, fresh).select(
        "page_id", F.aggregate("embedding", F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double")).alias("_s"), "embedding"
    ).select("page_id", F.round("_s", 4).alias("vector_sum"), F.size("embedding").alias("dims"))


def q_vector_preview(spark, d):
    v = tb.vectors(spark, d)
    entries = v.select("page_id", "label")
    return embed.preview(entries, v, dims=10, tags=["history", "preview"]).select(
        "page_id", "label", "preview_text", F.array_join("llm_tags", ",").alias("tags")
    )


def q_search_exact(spark, d):
    q = tb.places(spark, d).select("place_id", "url")
    return search.exact(q, ingested_pages(spark, d)).select("place_id", "url", "canonical_url", "page_id", "host")


def _text_queries(spark, d):
    """Whole texts of the documents whose id is divisible by 20."""
    return tb.read(spark, d, "documents").filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("qid"), "text")


def _vector_queries(spark, d):
    """The vectors whose id is divisible by 20."""
    return tb.vectors(spark, d).filter(F.col("page_id") % 20 == 0).select(F.col("page_id").alias("qid"), F.col("embedding").alias("vector"))


def q_search_bm25(spark, d):
    docs = tb.read(spark, d, "documents").select("doc_id", "text")
    return search.bm25(docs, _text_queries(spark, d), id_col="doc_id", text_cols=["text"], k=TOP_K)


def q_search_bm25_texts(spark, d):
    """Ten short texts as queries."""
    docs = tb.read(spark, d, "documents").select("doc_id", "text")
    texts = F.array(*[F.struct(F.lit(i).cast("long").alias("qid"), F.lit(t).alias("text")) for i, t in enumerate(TEXT_QUERIES)])
    return search.bm25(docs, spark.range(1).select(F.inline(texts)), id_col="doc_id", text_cols=["text"], k=TOP_K)


def q_search_pages(spark, d):
    """Q2 over ingested pages: the titles of pages whose id is divisible by 20, against the stored keyword index."""
    from ..operators import keyword_index
    from ..sources.scratch import scratch_path

    docs = documents.search_documents(ingested_pages(spark, d), tb.bookmarks(spark, d))
    index = keyword_index.update(spark, scratch_path(spark, "keyword_index"), docs)
    asked = docs.filter(F.col("page_id") % 20 == 0).select(F.col("page_id").alias("qid"), F.col("title").alias("text"))
    return keyword_index.search(index, asked, k=TOP_K, weights=FIELD_WEIGHTS)[0]


def q_search_knn(spark, d):
    return search.knn(tb.vectors(spark, d), _vector_queries(spark, d), k=TOP_K)


def q_search_hybrid(spark, d):
    docs = tb.read(spark, d, "documents").select("doc_id", "text")
    kw = search.bm25(docs, _text_queries(spark, d), id_col="doc_id", text_cols=["text"], k=HYBRID_DEPTH)
    return search.hybrid(kw, search.knn(tb.vectors(spark, d), _vector_queries(spark, d), k=HYBRID_DEPTH), k=TOP_K)


def q_search_ann(spark, d):
    return search.ann(tb.vectors(spark, d), _vector_queries(spark, d), k=TOP_K)


def q_encode_pages(spark, d):
    return embed.encode_pages(ingested_pages(spark, d), model_name=ACTIVE_MODEL, dims=64, batch_size=8)


def q_preview_ingest(spark, d):
    from .preview_ingest import run_preview_ingest

    previews, _, _ = run_preview_ingest(
        tb.history_snapshot(spark, d), rules=RULES, model_name=ACTIVE_MODEL, dims=64
    )
    return previews.select("browser", "profile", "canonical_url", "last_visit_date", "preview_text", "embedding_input")


def q_recent_pages(spark, d):
    return history.latest_pages(ingested_pages(spark, d), 20)


def q_recent_pages_by_host(spark, d):
    return history.latest_pages_per_host(ingested_pages(spark, d), 3).select("host", "page_id", "url", "last_seen_us", "rank")


def q_page_timeline(spark, d):
    return history.page_timeline(ingested_visits(spark, d), ingested_pages(spark, d), 5)


def q_visits_in_range(spark, d):
    as_of = tb.as_of_literal(spark, d)
    return history.visits_in_range(ingested_visits(spark, d, 1.0), as_of - tb.DAY_US, as_of)


def q_bookmarks_by_status(spark, d):
    return history.bookmarks_by_status(tb.bookmarks(spark, d), 10).select(
        "status", "bookmark_id", "page_id", "updated_at_us", "status_rank"
    )


def q_bookmarks_by_folder(spark, d):
    return history.bookmarks_by_folder(tb.bookmarks(spark, d), 5).select(
        "folder_id", "bookmark_id", "page_id", "updated_at_us", "folder_rank"
    )


def q_folder_tree(spark, d):
    return history.folder_tree(tb.folders(spark, d), tb.bookmarks(spark, d))


def q_integrity_audit(spark, d):
    return integrity.audit(
        pages=ingested_pages(spark, d),
        visits=ingested_visits(spark, d),
        profiles=ingest.register_profiles(None, ingest.stores_of(_visits(spark, d))).drop("is_new"),
        bookmarks=tb.bookmarks(spark, d),
        folders=tb.folders(spark, d),
        # each vector belongs to the model of its label
        embeddings=tb.vectors(spark, d).select("page_id", (F.col("label").cast("long") + 1).alias("model_id")),
        models=integrity.models_from_vectors(tb.vectors(spark, d), ACTIVE_MODEL),
    )


def q_cascade_purge(spark, d):
    pages = ingested_pages(spark, d)
    doomed = policy.annotate(pages, "url", ["-*.example.org"]).filter(~F.col("policy_allowed")).select("page_id")
    return integrity.purge_counts(
        doomed_pages=doomed,
        doomed_folders=tb.folders(spark, d).filter(F.col("folder_id") == F.lit(3)).select("folder_id"),
        pages=pages,
        visits=ingested_visits(spark, d),
        bookmarks=tb.bookmarks(spark, d),
        folders=tb.folders(spark, d),
        documents=documents.search_documents(pages, tb.bookmarks(spark, d)),
    )


def _history_tables(spark, d) -> dict[str, DataFrame]:
    """All history tables under the names of the declared constraints; every model serves the pages of one day of the week."""
    pages = ingested_pages(spark, d)
    models = integrity.models_from_vectors(tb.vectors(spark, d), ACTIVE_MODEL_OF_TABLES)
    model = F.pmod(F.floor(F.col("last_seen_us") / tb.DAY_US), F.lit(7)).cast("long") + 1
    return {
        "source_profiles": ingest.register_profiles(None, ingest.stores_of(_visits(spark, d))).drop("is_new"),
        "pages": pages,
        "visits": ingested_visits(spark, d),
        "bookmark_folders": tb.folders(spark, d),
        "bookmarks": tb.bookmarks(spark, d),
        "embedding_models": models,
        "page_embeddings": pages.select("page_id", model.alias("model_id"), embed.content_hash().alias("content_hash"), F.col("last_seen_us").alias("updated_at_us")),
        "page_text": documents.search_documents(pages, tb.bookmarks(spark, d)),
    }


def q_export_pages(spark, d):
    """Ingested pages written as sorted parts of equal size; rows and order-free digest of each part."""
    from ..sources import export
    from ..sources.scratch import scratch_path

    return export.export(ingested_pages(spark, d), scratch_path(spark, "export"), ["page_id"], parts=EXPORT_PARTS)


def q_constraint_audit(spark, d):
    """I1/I4 over all tables after careless deletions: pages of one domain, the stores of one browser, a folder, a model; visits and names repeated."""
    from ..operators import constraints

    t = _history_tables(spark, d)
    t["pages"] = t["pages"].filter(~F.col("host").like("%.example.org")).withColumn("title", F.when(F.col("title") != "(untitled)", F.col("title")))
    t["source_profiles"] = t["source_profiles"].filter(F.col("browser") != "zen")
    t["bookmark_folders"] = t["bookmark_folders"].filter(F.col("folder_id") != 3)
    t["visits"] = t["visits"].unionByName(t["visits"].filter(F.col("source_visit_id") % 20 == 0))
    models = t["embedding_models"].filter(F.col("model_id") != 2)
    t["embedding_models"] = models.withColumn("dimensions", F.when(F.col("model_id") == 4, F.lit(0)).otherwise(F.col("dimensions"))).withColumn("is_active", F.lit(True))
    return constraints.audit(t)


def q_constraint_purge(spark, d):
    """I2 over all tables: pages of one domain, the profiles of one browser and a folder go, with all that depends on them."""
    from ..operators import constraints

    t = _history_tables(spark, d)
    doomed = {
        "pages": t["pages"].filter(F.col("host").like("%.example.org")),
        "source_profiles": t["source_profiles"].filter(F.col("browser") == "firefox"),
        "bookmark_folders": t["bookmark_folders"].filter(F.col("folder_id") == 3),
    }
    return constraints.purge_counts(t, doomed)


def q_model_registry(spark, d):
    existing = integrity.models_from_vectors(tb.vectors(spark, d), "model-0")
    return integrity.register_model(existing, ACTIVE_MODEL, 64)


def q_model_counts(spark, d):
    models = integrity.register_model(integrity.models_from_vectors(tb.vectors(spark, d), "model-0"), ACTIVE_MODEL, 64)
    return integrity.model_counts(models)


def q_active_vectors(spark, d):
    v = tb.vectors(spark, d)
    models = integrity.register_model(integrity.models_from_vectors(v, "model-0"), ACTIVE_MODEL, 64)
    meta = v.select(
        "page_id",
        F.when(F.col("label") % 2 == 0, F.lit("model-0")).otherwise(F.lit(ACTIVE_MODEL)).alias("model_name"),
    ).join(models.select("model_name", "model_id"), "model_name")
    return integrity.active_vectors(meta.drop("model_name"), v.select("page_id", "embedding"), models).select(
        "page_id", "model_id", "dims"
    )


QUERIES: dict[str, QueryFn] = {
    "recent_visits": q_recent_visits,
    "history_topk": q_history_topk,
    "normalize_urls": q_normalize_urls,
    "dedupe_history": q_dedupe_history,
    "history_preview_input": q_history_preview_input,
    "snapshot_summary": q_snapshot_summary,
    "snapshot_summary_all": q_snapshot_summary,  # its earlier name
    "policy_filter": q_policy_filter,
    "policy_filter_all": q_policy_filter,  # its earlier name
    "policy_trace": q_policy_trace,
    "policy_preview": q_policy_preview,
    "policy_preview_counts": q_policy_preview_counts,
    "page_upsert": q_page_upsert,
    "incremental_merge": q_incremental_merge,
    "visit_insert_ignore": q_visit_insert_ignore,
    "visit_insert_ignore_all": q_visit_insert_ignore,  # its earlier name
    "profile_register": q_profile_register,
    "ingest_summary": q_ingest_summary,
    "search_documents": q_search_documents,
    "embedding_candidates": q_embedding_candidates,
    "content_hash_changes": q_content_hash_changes,
    "embedding_replace": q_embedding_replace,
    "vector_preview": q_vector_preview,
    "search_exact": q_search_exact,
    "search_bm25": q_search_bm25,
    "search_bm25_texts": q_search_bm25_texts,
    "search_pages": q_search_pages,
    "search_knn": q_search_knn,
    "search_hybrid": q_search_hybrid,
    "search_ann": q_search_ann,
    "encode_pages": q_encode_pages,
    "preview_ingest": q_preview_ingest,
    "recent_pages": q_recent_pages,
    "recent_pages_by_host": q_recent_pages_by_host,
    "page_timeline": q_page_timeline,
    "visits_in_range": q_visits_in_range,
    "bookmarks_by_status": q_bookmarks_by_status,
    "bookmarks_by_folder": q_bookmarks_by_folder,
    "folder_tree": q_folder_tree,
    "integrity_audit": q_integrity_audit,
    "cascade_purge": q_cascade_purge,
    "export_pages": q_export_pages,
    "constraint_audit": q_constraint_audit,
    "constraint_purge": q_constraint_purge,
    "model_registry": q_model_registry,
    "model_counts": q_model_counts,
    "active_vectors": q_active_vectors,
}
