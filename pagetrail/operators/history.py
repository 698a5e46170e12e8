"""History snapshot operators and the access paths over the ingested tables.

Snapshot (preview) path:
  per-store rows -> per-profile newest-k (W1) -> canonical URL, drop invalid (P1, F3)
  -> clean title (P3) -> one row per canonical URL (A1) -> policy (F5)
  -> date desc order (O1) -> optional max_items (O2)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..functions.urls import with_canonical_url
from ..session import ensure_checkpoint_dir
from . import policy

ENTRY_COLUMNS = ["browser", "profile", "title", "url", "canonical_url", "last_visit_date"]


def nonblank_url(df: DataFrame, col: str = "url") -> DataFrame:
    """url not null and not blank (spaces only, as SQL TRIM)."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != F.lit("")))


def newest_per_profile(snapshot: DataFrame, limit_per_profile: int | None) -> DataFrame:
    """Per (browser, profile) the k newest rows by (last_visit_date desc, id desc).

    Applied before invalid URLs are dropped. ``None`` or <= 0 means no limit.
    Planned as a WindowGroupLimit, which trims rows before the shuffle.
    """
    s = nonblank_url(snapshot).withColumn("last_visit_date", F.coalesce(F.col("last_visit_date"), F.lit(0)))
    if not limit_per_profile or limit_per_profile <= 0:
        return s
    w = Window.partitionBy("browser", "profile").orderBy(F.col("last_visit_date").desc(), F.col("id").desc())
    return s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= int(limit_per_profile)).drop("_rn")


def history_entries(snapshot: DataFrame, limit_per_profile: int | None = None) -> DataFrame:
    """HistoryEntry rows (browser, profile, title, url, canonical_url, last_visit_date)."""
    s = newest_per_profile(snapshot, limit_per_profile)
    if "canonical_url" not in s.columns:  # computed upstream when places are shared by stores
        s = with_canonical_url(s, "url", "canonical_url")
    out = s.select(
        "browser",
        "profile",
        clean_title("title").alias("title"),
        F.col("url"),
        "canonical_url",
        F.col("last_visit_date").cast("long").alias("last_visit_date"),
    )
    return out.filter(F.col("canonical_url").isNotNull())


def dedupe(entries: DataFrame) -> DataFrame:
    """A1: one row per canonical URL -- newest date, then smallest (browser, profile, url, title).

    A grouped ``min_by`` keeps the partial (map-side) aggregation, so each
    partition ships at most one row per URL into the shuffle.
    """
    key = F.struct(
        (-F.col("last_visit_date")).alias("d"), F.col("browser"), F.col("profile"), F.col("url"), F.col("title")
    )
    row = F.struct(*[F.col(c) for c in ENTRY_COLUMNS if c != "canonical_url"])
    best = entries.groupBy("canonical_url").agg(F.min_by(row, key).alias("e"))
    return best.select("e.browser", "e.profile", "e.title", "e.url", "canonical_url", "e.last_visit_date")


def ordered(entries: DataFrame) -> DataFrame:
    """O1: newest first, then canonical URL, then title."""
    return entries.orderBy(F.col("last_visit_date").desc(), "canonical_url", "title")


def preview_entries(
    snapshot: DataFrame,
    *,
    rules=(),
    limit_per_profile: int | None = None,
    max_items: int | None = None,
    policy_mode: str = "inline",
) -> DataFrame:
    """The preview-ingest selection: dedupe, policy on the canonical URL, order, cap (O2)."""
    d = dedupe(history_entries(snapshot, limit_per_profile))
    d = policy.filter_allowed(d, "canonical_url", rules, mode=policy_mode)
    d = ordered(d)
    if max_items is not None:
        d = d.limit(max(0, int(max_items)))
    return d


def snapshot_summary(
    snapshot: DataFrame, previews: DataFrame, *, limit_per_profile: int | None = None, stores: DataFrame | None = None
) -> DataFrame:
    """Stores (the discovered ones if given, else those with rows), rows loaded (after invalid URLs dropped), rows selected."""
    loaded = history_entries(snapshot, limit_per_profile)
    stores = (snapshot if stores is None else stores).select("browser", "profile").distinct()

    def n(df: DataFrame):
        return df.select(F.count(F.lit(1))).scalar()

    return snapshot.sparkSession.range(1).select(
        n(stores).alias("discovered_profile_count"),
        n(loaded).alias("loaded_row_count"),
        n(previews).alias("deduped_row_count"),
    )


# --- access paths over the ingested tables (H1-H7) ---------------------------------------


def latest_pages(pages: DataFrame, k: int) -> DataFrame:
    """H1: the k most recently seen pages (ties by page_id)."""
    return pages.orderBy(F.col("last_seen_us").desc(), "page_id").limit(int(k))


def latest_pages_per_host(pages: DataFrame, k: int) -> DataFrame:
    """H2: per host, the k most recently seen pages ("lost tab" finder)."""
    return _top_k(pages, ["host"], [F.col("last_seen_us").desc(), F.col("page_id")], k, "rank")


def _top_k(df: DataFrame, keys: list[str], order: list, k: int, rank_col: str) -> DataFrame:
    """Per-group top-k by ``row_number() <= k``.

    Planned as WindowGroupLimit: every map task keeps at most k rows per
    group before the shuffle, so a hot group never lands whole in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= int(k))


def page_timeline(visits: DataFrame, pages: DataFrame, k: int = 20) -> DataFrame:
    """H3: the k latest visits of each page with the gap to the visit before it."""
    order = [F.col("visited_at_us").desc(), F.col("visit_id").desc()]
    recent = _top_k(visits.select("page_id", "visit_id", "visited_at_us"), ["page_id"], order, k + 1, "visit_rank")
    w = Window.partitionBy("page_id").orderBy(*order)
    with_prev = recent.withColumn("previous_visit_us", F.lead("visited_at_us", 1).over(w)).filter(
        F.col("visit_rank") <= int(k)
    )
    return with_prev.join(pages.select("page_id", "url", "host"), "page_id").select(
        "page_id", "url", "host", "visit_id", "visited_at_us", "visit_rank", "previous_visit_us"
    )


def visits_in_range(visits: DataFrame, start_us: int | F.Column, end_us: int | F.Column) -> DataFrame:
    """H4: visits with start <= time < end, newest first (range-partitioned sort)."""
    s = start_us if isinstance(start_us, F.Column) else F.lit(int(start_us))
    e = end_us if isinstance(end_us, F.Column) else F.lit(int(end_us))
    return visits.filter((F.col("visited_at_us") >= s) & (F.col("visited_at_us") < e)).orderBy(
        F.col("visited_at_us").desc(), F.col("visit_id").desc()
    )


def live_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """bookmarks that are not soft-deleted."""
    return bookmarks.filter(F.col("deleted_at_us").isNull())


def bookmarks_by_status(bookmarks: DataFrame, k: int, status: str | None = None) -> DataFrame:
    """H5: per status, the k most recently updated live bookmarks."""
    b = live_bookmarks(bookmarks)
    if status is not None:
        b = b.filter(F.col("status") == F.lit(status))
    return _top_k(b, ["status"], [F.col("updated_at_us").desc(), F.col("bookmark_id")], k, "status_rank")


def bookmarks_by_folder(bookmarks: DataFrame, k: int, folder_id: int | None = None) -> DataFrame:
    """H6: per folder, the k most recently updated live bookmarks."""
    b = live_bookmarks(bookmarks).filter(F.col("folder_id").isNotNull())
    if folder_id is not None:
        b = b.filter(F.col("folder_id") == F.lit(int(folder_id)))
    return _top_k(b, ["folder_id"], [F.col("updated_at_us").desc(), F.col("bookmark_id")], k, "folder_rank")


def folder_tree(folders: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """H7: folder closure (folder_id, ancestor_id, depth) by pointer doubling, any depth and size.

    Round r joins the ancestors at distance 2**r to all pairs up to that
    distance, so a chain of depth d takes log2(d) rounds. A folder on or below
    a parent cycle gets each of its ancestors once, at the smallest distance.
    With ``bookmarks``: per folder, live bookmarks in its subtree, folders in
    its subtree and its level. Bookmarks are counted per folder before they
    meet the (folder-sized) closure, so only one row per folder is joined.
    """
    ensure_checkpoint_dir(folders.sparkSession)
    own = folders.select("folder_id").distinct()
    jump = folders.select("folder_id", F.col("parent_folder_id").alias("to")).filter("`to` is not null").distinct().checkpoint()
    ends = own.unionByName(jump.select(F.col("to").alias("folder_id"))).distinct()
    closure = ends.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    distance, total = 1, ends.count()
    while distance <= total and not jump.isEmpty():
        up = closure.select(F.col("folder_id").alias("to"), "ancestor_id", (F.col("depth") + distance).alias("depth"))
        both = closure.unionByName(jump.join(up, "to").select("folder_id", "ancestor_id", "depth"))
        closure = both.groupBy("folder_id", "ancestor_id").agg(F.min("depth").alias("depth")).checkpoint()
        ahead = jump.select(F.col("folder_id").alias("to"), F.col("to").alias("next"))
        jump = jump.join(ahead, "to").select("folder_id", F.col("next").alias("to")).checkpoint()
        distance *= 2
    closure = closure.join(own, "folder_id", "left_semi")
    if bookmarks is None:
        return closure
    per_folder = live_bookmarks(bookmarks).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    sub = (
        closure.join(per_folder, "folder_id", "left")
        .groupBy(F.col("ancestor_id").alias("folder_id"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("subtree_bookmarks"),
            F.count(F.lit(1)).alias("subtree_folders"),
        )
    )
    level = closure.groupBy("folder_id").agg(F.max("depth").alias("level"))
    return sub.join(level, "folder_id")
