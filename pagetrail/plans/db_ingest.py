"""End-to-end ingest of recent visits into the history tables (pipeline B).

recent visits (S3, URL work on the places side) -> policy (D2) -> annotated visits
  -> summary counters (A4)
  -> page upsert (A2)          -> search documents for touched pages (E1)
  -> insert-or-ignore visits (J5)                    -> encode + persist vectors (E2-E7)
  -> profile registration (J3)

The annotated visits feed several consumers, so they are checkpointed once
into the cluster's checkpoint folder (cut lineage, survives executor loss).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, documents, embed, ingest, integrity
from ..session import ensure_checkpoint_dir
from ..sources import profile_store


@dataclass
class HistoryTables:
    pages: DataFrame | None = None
    visits: DataFrame | None = None
    profiles: DataFrame | None = None
    documents: DataFrame | None = None
    embedding_meta: DataFrame | None = None
    vectors: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def run_ingest_db(
    spark: SparkSession,
    *,
    places: DataFrame,
    visits: DataFrame,
    as_of_us: int,
    since_days: float,
    rules=(),
    existing: HistoryTables | None = None,
    bookmarks: DataFrame | None = None,
    encoder: embed.Encoder | None = None,
    model_name: str = "hash-64",
    model_id: int = 1,
    dims: int = 64,
    batch_size: int = 8,
    keys: tuple[str, ...] = ("browser", "profile", "place_id"),
    load_errors: DataFrame | None = None,
    stores: DataFrame | None = None,
    checkpoint: bool = True,
    skip_unchanged: bool = False,
    encode_budget: int | None = None,
    models: DataFrame | None = None,
    verify: bool = False,
) -> tuple[HistoryTables, DataFrame, DataFrame]:
    """Returns (new tables, one-row summary, embedding error rows).

    Like the reference, every touched page is re-encoded; ``skip_unchanged``
    (an extension) encodes only pages whose content hash differs from the
    stored one for this model. ``encode_budget`` encodes only the most
    recently seen pages first (O3: last_seen desc, page_id), up to the budget.
    ``stores`` is the list of discovered stores (``profile_store.stores_table``);
    without it only stores that have visits are known. ``models`` is the model
    registry: its one active model gives id, name and dimensions (I4), and vectors stored
    before must have these dimensions (I5). ``verify`` audits the resulting tables
    and raises ``constraints.IntegrityError`` instead of returning tables that violate a constraint.
    """
    prev = existing or HistoryTables()
    if models is not None:
        model_id, model_name, dims = integrity.assert_one_active(models)
        if prev.vectors is not None:
            integrity.check_dimensions(prev.vectors, dims)
    cut = ingest.cutoff_us(as_of_us, since_days)
    annotated = ingest.annotated_visit_rows(visits, places, cut, rules, keys=keys)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        annotated = annotated.checkpoint(eager=True)
    allowed = annotated.filter(F.col("status") == F.lit("allowed"))

    pages = ingest.merge_pages(prev.pages, ingest.page_batch(allowed))
    merged_visits = ingest.merge_visits(prev.visits, ingest.visit_batch(allowed))
    stores = ingest.stores_of(visits if stores is None else stores)
    profiles = ingest.register_profiles(prev.profiles, stores)

    touched = allowed.select(ingest.page_id_of("canonical_url").alias("page_id")).distinct()
    if bookmarks is None:
        bookmarks = spark.createDataFrame(
            [], "bookmark_id long, page_id long, title_override string, notes string, deleted_at_us long"
        )
    fresh_docs = documents.search_documents(pages, bookmarks, touched)
    docs = documents.replace_documents(prev.documents, fresh_docs)

    to_encode = pages.join(touched, "page_id", "left_semi")
    if skip_unchanged and prev.embedding_meta is not None:
        changed = embed.hash_changes(to_encode, prev.embedding_meta, model_id).filter("needs_embedding")
        to_encode = to_encode.join(changed.select("page_id"), "page_id", "left_semi")
    if encode_budget is not None:
        to_encode = to_encode.orderBy(F.col("last_seen_us").desc(), "page_id").limit(max(0, int(encode_budget)))
    encoded = embed.encode_pages(to_encode, model_name=model_name, dims=dims, encoder=encoder, batch_size=batch_size)
    if checkpoint:
        encoded = encoded.checkpoint(eager=True)
    meta, vectors = embed.persist(encoded, pages, model_id, int(as_of_us), prev.embedding_meta, prev.vectors)

    n_stores = stores.select(F.count(F.lit(1))).scalar()
    base = ingest.summary(annotated, n_stores, prev.visits)
    synced = encoded.select(F.count_if(F.col("embedding").isNotNull())).scalar()
    failed = encoded.select(F.count_if(F.col("embedding").isNull())).scalar()
    n_errors = load_errors.select(F.count(F.lit(1))).scalar() if load_errors is not None else F.lit(0)
    summary = base.select(
        "*",
        synced.alias("embeddings_synced"),
        failed.alias("embed_errors"),
        F.col("pages_touched").alias("fts_rows_synced"),
        n_errors.cast("long").alias("load_errors"),
    )
    errors = encoded.filter(F.col("embedding").isNull()).select("page_id", "reason", "error")
    tables = HistoryTables(
        pages=pages,
        visits=merged_visits.drop("is_new"),
        profiles=profiles.drop("is_new"),
        documents=docs,
        embedding_meta=meta,
        vectors=vectors,
    )
    if verify:
        constraints.gate(constrained(tables, models))
    return tables, summary, errors


def constrained(tables: HistoryTables, models: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables under the names of ``constraints.SCHEMA``."""
    named = {
        "pages": tables.pages,
        "visits": tables.visits,
        "source_profiles": tables.profiles,
        "page_text": tables.documents,
        "page_embeddings": tables.embedding_meta,
        "page_embedding_vec": tables.vectors,
        "embedding_models": models,
    }
    return {name: df for name, df in named.items() if df is not None}


def ingest_stores(
    spark: SparkSession,
    roots: dict[str, str],
    *,
    browsers: list[str] | None = None,
    override: list[str] | None = None,
    **options,
) -> tuple[HistoryTables, DataFrame, DataFrame]:
    """:func:`run_ingest_db` over the profile stores of the selected browsers (F6); ``roots``: browser -> folder of its profiles."""
    chosen = profile_store.select_browsers(browsers, override)
    listed = profile_store.discover(spark, [(b, roots[b]) for b in chosen if b in roots])
    places, visits, errors = profile_store.read_stores(spark, [], stores=listed)
    return run_ingest_db(
        spark, places=places, visits=visits, load_errors=errors, stores=profile_store.stores_table(spark, listed), **options
    )
