"""Constraint audit (I1), cascading purge (I2), model registry (I3, I4), dimension guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import folder_tree

MODEL_COLUMNS = ["model_id", "model_name", "dimensions", "is_active"]


def _dupes(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.select(F.lit(check).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def _orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, check: str) -> DataFrame:
    # count per key first (partial aggregation), so a hot key reaches the anti-join as one row
    c = child.select(F.col(fk).alias("_k")).filter(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))
    missing = c.join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return missing.select(F.lit(check).alias("check"), F.col("_k").cast("string").alias("key"), "n")


def _nulls(df: DataFrame, cols: list[str], check: str) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.filter(bad).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
        F.lit(check).alias("check"), F.lit("*").alias("key"), "n"
    )


def audit(
    *,
    pages: DataFrame,
    visits: DataFrame,
    profiles: DataFrame,
    bookmarks: DataFrame,
    folders: DataFrame,
    embeddings: DataFrame,
    models: DataFrame,
) -> DataFrame:
    """Violation rows (check, key, n) for unique keys, not-null, checks and foreign keys."""
    parts = [
        _dupes(pages, ["url"], "pages.url unique"),
        _dupes(pages, ["page_id"], "pages.page_id unique"),
        _nulls(pages, ["url", "host", "title", "first_seen_us", "last_seen_us", "normalization_version"], "pages not null"),
        _dupes(visits, ["source_profile_id", "source_visit_id"], "visits (profile, source visit) unique"),
        _orphans(visits, "page_id", pages, "page_id", "visits.page_id -> pages"),
        _orphans(visits, "source_profile_id", profiles, "source_profile_id", "visits.source_profile_id -> profiles"),
        _dupes(profiles, ["profile_key"], "profiles.profile_key unique"),
        _orphans(bookmarks, "page_id", pages, "page_id", "bookmarks.page_id -> pages"),
        _orphans(bookmarks, "folder_id", folders, "folder_id", "bookmarks.folder_id -> folders"),
        _orphans(folders, "parent_folder_id", folders, "folder_id", "folders.parent -> folders"),
        _orphans(embeddings, "page_id", pages, "page_id", "page_embeddings.page_id -> pages"),
        _orphans(embeddings, "model_id", models, "model_id", "page_embeddings.model_id -> models"),
        _dupes(models, ["model_name"], "models.model_name unique"),
        models.filter(F.col("dimensions") <= 0).select(
            F.lit("models.dimensions > 0").alias("check"), F.col("model_name").alias("key"), F.lit(1).cast("long").alias("n")
        ),
        models.agg(F.count_if(F.col("is_active")).alias("a")).filter(F.col("a") != 1).select(
            F.lit("exactly one active model").alias("check"), F.col("a").cast("string").alias("key"), F.lit(1).cast("long").alias("n")
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge_counts(
    *,
    doomed_pages: DataFrame,
    doomed_folders: DataFrame,
    pages: DataFrame,
    visits: DataFrame,
    bookmarks: DataFrame,
    folders: DataFrame,
    documents: DataFrame,
) -> DataFrame:
    """Apply the cascade and report (table, rows_before, rows_after, rows_nulled)."""
    t = purge(
        doomed_pages=doomed_pages,
        doomed_folders=doomed_folders,
        pages=pages,
        visits=visits,
        bookmarks=bookmarks,
        folders=folders,
        documents=documents,
    )

    spark = pages.sparkSession

    def row(name: str, before: DataFrame, after: DataFrame, nulled=None) -> DataFrame:
        # one-row result from scalar subqueries (no join between the single-row aggregates)
        b = before.select(F.count(F.lit(1))).scalar()
        a = after.select(F.count(F.lit(1))).scalar()
        z = after.select(F.count_if(nulled)).scalar() if nulled is not None else F.lit(0)
        return spark.range(1).select(
            F.lit(name).alias("table"), b.alias("rows_before"), a.alias("rows_after"), z.cast("long").alias("rows_nulled")
        )

    return (
        row("pages", pages, t["pages"])
        .unionByName(row("visits", visits, t["visits"]))
        .unionByName(row("bookmarks", bookmarks, t["bookmarks"], F.col("folder_nulled")))
        .unionByName(row("folders", folders, t["folders"]))
        .unionByName(row("documents", documents, t["documents"]))
    )


def purge(
    *,
    doomed_pages: DataFrame,
    doomed_folders: DataFrame,
    pages: DataFrame,
    visits: DataFrame,
    bookmarks: DataFrame,
    folders: DataFrame,
    documents: DataFrame,
) -> dict[str, DataFrame]:
    """Cascade: removed pages take their visits, bookmarks and documents; removed folders
    take their sub-folders; bookmarks of removed folders keep living with folder_id = null."""
    dp = doomed_pages.select("page_id").distinct()
    closure = folder_tree(folders)
    df_ = closure.join(doomed_folders.select(F.col("folder_id").alias("ancestor_id")), "ancestor_id").select("folder_id").distinct()
    kept_bm = bookmarks.join(dp, "page_id", "left_anti")
    kept_bm = kept_bm.join(df_.withColumn("_gone", F.lit(True)), "folder_id", "left")
    kept_bm = kept_bm.withColumn("folder_nulled", F.coalesce(F.col("_gone"), F.lit(False))).withColumn(
        "folder_id", F.when(F.col("folder_nulled"), F.lit(None).cast("long")).otherwise(F.col("folder_id"))
    ).drop("_gone")
    return {
        "pages": pages.join(dp, "page_id", "left_anti"),
        "visits": visits.join(dp, "page_id", "left_anti"),
        "bookmarks": kept_bm,
        "folders": folders.join(df_, "folder_id", "left_anti"),
        "documents": documents.join(dp, "page_id", "left_anti"),
    }


def models_from_vectors(vectors: DataFrame, active_name: str, group_col: str = "label") -> DataFrame:
    """A registry with one model per vector group (``model-<group>``), dimension from its vectors."""
    g = vectors.groupBy(F.col(group_col).cast("long").alias("g")).agg(F.max(F.size("embedding")).alias("dimensions"))
    return g.select(
        (F.col("g") + 1).alias("model_id"),
        F.concat(F.lit("model-"), F.col("g").cast("string")).alias("model_name"),
        F.col("dimensions").cast("int").alias("dimensions"),
    ).withColumn("is_active", F.col("model_name") == F.lit(active_name))


def register_model(models: DataFrame, name: str, dimensions: int) -> DataFrame:
    """Register or refresh ``name`` with its dimension and make it the only active model."""
    if int(dimensions) <= 0:
        raise ValueError("dimensions must be positive")
    if not name.strip():
        raise ValueError("a model needs a name")
    known = models.select(F.count_if(F.col("model_name") == F.lit(name)) > 0).scalar()
    next_id = models.select(F.coalesce(F.max("model_id"), F.lit(0)) + 1).scalar()
    fresh = (
        models.sparkSession.range(1)
        .select(next_id.alias("model_id"), F.lit(name).alias("model_name"), F.lit(int(dimensions)).alias("dimensions"))
        .filter(~known)
    )
    refreshed = models.select(
        "model_id",
        "model_name",
        F.when(F.col("model_name") == F.lit(name), F.lit(int(dimensions))).otherwise(F.col("dimensions")).alias("dimensions"),
    )
    return refreshed.unionByName(fresh).withColumn("is_active", F.col("model_name") == F.lit(name))


def model_counts(models: DataFrame) -> DataFrame:
    """Total and active models."""
    return models.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_active")).alias("active"))


def assert_one_active(models: DataFrame) -> tuple[int, str, int]:
    """I4: exactly one active model; returns (model_id, name, dimensions)."""
    rows = models.filter(F.col("is_active")).select("model_id", "model_name", "dimensions").limit(2).collect()
    if len(rows) != 1:
        raise RuntimeError(f"{len(rows)} active models found (2 stands for more), one is needed")
    r = rows[0]
    return int(r[0]), str(r[1]), int(r[2])


def check_dimensions(vectors: DataFrame, dimensions: int) -> None:
    """Abort when any vector's size differs from the registered dimension."""
    bad = vectors.filter(F.size("embedding") != F.lit(int(dimensions))).select("page_id").limit(1).collect()
    if bad:
        raise ValueError(f"vector dimension mismatch for page_id={bad[0][0]}: expected {dimensions}")


def active_vectors(meta: DataFrame, vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Vectors whose metadata names the active model and whose size matches it."""
    active = models.filter(F.col("is_active")).select("model_id", "dimensions")
    j = meta.select("page_id", "model_id").join(active, "model_id").join(vectors.select("page_id", "embedding"), "page_id")
    return j.filter(F.size("embedding") == F.col("dimensions")).select(
        "page_id", "model_id", F.size("embedding").alias("dims"), "embedding"
    )
