"""Visit ingest: recent-visit scan, page upsert, insert-or-ignore visits, profiles, summary.

Identity is by natural key, never by a global counter:
  page      -> url                              page_id = first 15 hex digits of sha256(url)
  visit     -> (source_profile_id, source_visit_id)
  profile   -> profile_key = sha256("browser:store_path")
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title
from ..functions.urls import with_canonical_url, with_url_host
from . import policy

NORMALIZATION_VERSION = 1

PAGE_COLUMNS = ["page_id", "url", "host", "title", "first_seen_us", "last_seen_us", "normalization_version"]
VISIT_COLUMNS = ["visit_id", "page_id", "visited_at_us", "title_snapshot", "source_profile_id", "source_visit_id"]
PROFILE_COLUMNS = ["source_profile_id", "browser", "profile_key", "label"]


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hex_id(hex_col: str | Column) -> Column:
    """bigint from the first 15 hex digits (60 bits, always positive)."""
    return F.conv(F.substring(_c(hex_col), 1, 15), 16, 10).cast("long")


def page_id_of(url: str | Column) -> Column:
    return hex_id(F.sha2(_c(url), 256))


def profile_key(browser: str | Column = "browser", path: str | Column = "store_path") -> Column:
    return F.sha2(F.concat_ws(":", _c(browser), _c(path)), 256)


def cutoff_us(as_of_us: int | Column, since_days: float) -> Column:
    """Inclusive lower bound of the look-back window, from an explicit reference time."""
    span = int(max(0.0, float(since_days)) * 86_400 * 1_000_000)
    base = as_of_us if isinstance(as_of_us, Column) else F.lit(int(as_of_us))
    return base - F.lit(span)


def recent_visit_rows(visits: DataFrame, places: DataFrame, cutoff: int | Column | None) -> DataFrame:
    """Visits joined to their place within the window.

    ``visits``: visit_id, place_id, visit_date, browser, profile, browser_rank, store_path.
    ``places``: place_id, url, title.
    """
    v = visits
    if cutoff is not None:
        c = cutoff if isinstance(cutoff, Column) else F.lit(int(cutoff))
        v = v.filter(F.coalesce(F.col("visit_date"), F.lit(0)) >= c)
    p = places.filter(F.col("url").isNotNull() & (F.trim(F.col("url")) != F.lit("")))
    return v.join(p, "place_id").select(
        "browser",
        "profile",
        "browser_rank",
        "store_path",
        F.col("visit_id").alias("source_visit_id"),
        F.col("url").alias("raw_url"),
        F.coalesce(F.col("title"), F.lit("")).alias("raw_title"),
        F.coalesce(F.col("visit_date"), F.lit(0)).alias("visited_at_us"),
    )


def annotate_places(places: DataFrame, rules=(), *, policy_mode: str = "inline") -> DataFrame:
    """Per-URL work, done once per place rather than once per visit.

    Adds canonical_url, host, title (clean) and status (invalid / denied /
    allowed) to a places table (place_id, url, title, ...).
    """
    p = places.filter(F.col("url").isNotNull() & (F.trim(F.col("url")) != F.lit("")))
    out = with_url_host(with_canonical_url(p, "url", "canonical_url"), "canonical_url", "host")
    compiled = policy._as_rules(places.sparkSession, list(rules))
    valid = F.col("canonical_url").isNotNull() & (F.col("host") != F.lit(""))
    if compiled:
        out = policy.annotate(out, "canonical_url", compiled, prefix="_pol_", mode=policy_mode)
        allowed = F.col("_pol_allowed")
    else:
        allowed = F.lit(True)
    status = F.when(~valid | F.col("canonical_url").isNull(), F.lit("invalid")).when(allowed, F.lit("allowed")).otherwise(
        F.lit("denied")
    )
    return out.select(
        *places.columns,
        "canonical_url",
        "host",
        status.alias("status"),
        clean_title(F.coalesce(F.col("title"), F.lit(""))).alias("clean_title"),
    )


def annotated_visit_rows(
    visits: DataFrame,
    places: DataFrame,
    cutoff: int | Column | None,
    rules=(),
    *,
    keys: tuple[str, ...] = ("place_id",),
    policy_mode: str = "inline",
) -> DataFrame:
    """Recent visits (S3) already annotated: the URL work ran on the places side of the join.

    ``keys``: join keys between visits and places -- ``place_id`` when places
    are shared, (browser, profile, place_id) for per-store place tables.
    """
    v = visits
    if cutoff is not None:
        c = cutoff if isinstance(cutoff, Column) else F.lit(int(cutoff))
        v = v.filter(F.coalesce(F.col("visit_date"), F.lit(0)) >= c)
    ap = annotate_places(places.select(*keys, "url", "title"), rules, policy_mode=policy_mode)
    j = v.join(ap, list(keys))
    return j.select(
        "browser",
        "profile",
        "browser_rank",
        "store_path",
        F.col("visit_id").alias("source_visit_id"),
        F.col("url").alias("raw_url"),
        F.coalesce(F.col("title"), F.lit("")).alias("raw_title"),
        F.coalesce(F.col("visit_date"), F.lit(0)).alias("visited_at_us"),
        "canonical_url",
        "host",
        "status",
        F.col("clean_title").alias("title"),
        hex_id(profile_key()).alias("source_profile_id"),
    )


def annotate_visits(rows: DataFrame, rules=(), *, policy_mode: str = "inline") -> DataFrame:
    """Canonical URL, host, clean title and a status: invalid / denied / allowed."""
    out = with_url_host(with_canonical_url(rows, "raw_url", "canonical_url"), "canonical_url", "host")
    compiled = policy._as_rules(rows.sparkSession, list(rules))
    valid = F.col("canonical_url").isNotNull() & (F.col("host") != F.lit(""))
    if compiled:
        out = policy.annotate(out, "canonical_url", compiled, prefix="_pol_", mode=policy_mode)
        allowed = F.col("_pol_allowed")
    else:
        allowed = F.lit(True)
    out = out.withColumn(
        "status",
        F.when(~valid | F.col("canonical_url").isNull(), F.lit("invalid"))
        .when(allowed, F.lit("allowed"))
        .otherwise(F.lit("denied")),
    )
    out = out.select(*rows.columns, "canonical_url", "host", "status")
    return out.withColumn("title", clean_title("raw_title")).withColumn(
        "source_profile_id", hex_id(profile_key())
    )


def page_batch(allowed: DataFrame, title_policy: str = "reference") -> DataFrame:
    """One row per canonical URL from a batch of allowed visits (A2, batch side).

    ``reference``: the title of the last row the sequential ingest would write --
    stores in (browser order, profile), rows newest first, so the oldest visit
    of the last store. ``latest_real``: newest visit whose title is not the
    placeholder, else the placeholder. ``newest``: the title of the newest visit,
    the greater one of equally new; batches merged in any order end in the same title.
    """
    if title_policy == "reference":
        order = F.struct(
            F.col("browser_rank"), F.col("profile"), -F.col("visited_at_us"), -F.col("source_visit_id")
        )
        title = F.max_by("title", order)
    elif title_policy == "latest_real":
        real = F.col("title") != F.lit("(untitled)")
        order = F.struct(real.cast("int"), F.col("visited_at_us"), F.col("source_visit_id"))
        title = F.max_by("title", order)
    elif title_policy == "newest":
        title = F.max_by("title", F.struct("visited_at_us", "title"))
    else:
        raise ValueError(f"unknown title_policy {title_policy!r}")
    return allowed.groupBy(F.col("canonical_url").alias("url")).agg(
        F.first("host").alias("host"),
        title.alias("title"),
        F.min("visited_at_us").alias("first_seen_us"),
        F.max("visited_at_us").alias("last_seen_us"),
    )


def merge_pages(existing: DataFrame | None, batch: DataFrame, title_policy: str = "reference") -> DataFrame:
    """Upsert: first_seen = min, last_seen = max, host/title from the batch, version kept.

    With the ``newest`` policy the title of the side seen last stays.
    """
    b = batch.select(
        page_id_of("url").alias("page_id"), "url", "host", "title", "first_seen_us", "last_seen_us",
        F.lit(NORMALIZATION_VERSION).alias("normalization_version"),
    )
    if existing is None:
        return b.select(*PAGE_COLUMNS)
    e = existing.select(*PAGE_COLUMNS).alias("e")
    n = b.alias("n")
    j = e.join(n, F.col("e.url") == F.col("n.url"), "full_outer")

    def pick(name: str) -> Column:
        return F.coalesce(F.col(f"n.{name}"), F.col(f"e.{name}"))

    title = pick("title")
    if title_policy == "newest":
        old, new = F.struct("e.last_seen_us", "e.title"), F.struct("n.last_seen_us", "n.title")
        both = F.col("e.url").isNotNull() & F.col("n.url").isNotNull()
        title = F.when(both, F.greatest(old, new)["title"]).otherwise(title)
    return j.select(
        pick("page_id").alias("page_id"),
        pick("url").alias("url"),
        pick("host").alias("host"),
        title.alias("title"),
        F.least(F.col("e.first_seen_us"), F.col("n.first_seen_us")).alias("first_seen_us"),
        F.greatest(F.col("e.last_seen_us"), F.col("n.last_seen_us")).alias("last_seen_us"),
        F.coalesce(F.col("e.normalization_version"), F.col("n.normalization_version")).alias("normalization_version"),
    )


def visit_batch(allowed: DataFrame) -> DataFrame:
    """Visit rows of a batch, one per (source_profile_id, source_visit_id)."""
    v = allowed.select(
        hex_id(F.sha2(F.concat_ws(":", F.col("source_profile_id").cast("string"), F.col("source_visit_id").cast("string")), 256)).alias("visit_id"),
        page_id_of("canonical_url").alias("page_id"),
        "visited_at_us",
        F.col("title").alias("title_snapshot"),
        "source_profile_id",
        "source_visit_id",
    )
    # rows that repeat a key: the newest counts, then the smallest page and title
    newest = Window.partitionBy("source_profile_id", "source_visit_id").orderBy(
        F.col("visited_at_us").desc(), "page_id", "title_snapshot"
    )
    return v.withColumn("_i", F.row_number().over(newest)).filter(F.col("_i") == 1).drop("_i")


def merge_visits(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Insert-or-ignore (J5): existing rows win and are never updated. Adds ``is_new``."""
    if existing is None:
        return batch.select(*VISIT_COLUMNS, F.lit(True).alias("is_new"))
    key = ["source_profile_id", "source_visit_id"]
    new = batch.join(existing.select(*key), key, "left_anti")
    return existing.select(*VISIT_COLUMNS, F.lit(False).alias("is_new")).unionByName(
        new.select(*VISIT_COLUMNS, F.lit(True).alias("is_new"))
    )


def stores_of(visits: DataFrame) -> DataFrame:
    """Distinct profile stores: browser, profile, browser_rank, store_path."""
    return visits.select("browser", "profile", "browser_rank", "store_path").distinct()


def register_profiles(existing: DataFrame | None, stores: DataFrame) -> DataFrame:
    """Get-or-insert profiles by key (J3, P8). Adds ``is_new``."""
    s = stores.select(
        hex_id(profile_key()).alias("source_profile_id"),
        "browser",
        profile_key().alias("profile_key"),
        F.lit(None).cast("string").alias("label"),
    ).dropDuplicates(["profile_key"])
    if existing is None:
        return s.withColumn("is_new", F.lit(True))
    new = s.join(existing.select("profile_key"), "profile_key", "left_anti")
    return existing.select(*PROFILE_COLUMNS, F.lit(False).alias("is_new")).unionByName(
        new.select(*PROFILE_COLUMNS, F.lit(True).alias("is_new"))
    )


def summary(annotated: DataFrame, n_stores: Column | int, existing_visits: DataFrame | None = None) -> DataFrame:
    """Ingest counters (A4) in one aggregation over the annotated visits."""
    a = annotated
    if existing_visits is not None:
        key = ["source_profile_id", "source_visit_id"]
        known = existing_visits.select(*key).withColumn("_known", F.lit(True))
        a = a.join(known, key, "left")
    else:
        a = a.withColumn("_known", F.lit(None).cast("boolean"))
    allowed = F.col("status") == F.lit("allowed")
    new_visit = allowed & F.col("_known").isNull()
    n = n_stores if isinstance(n_stores, Column) else F.lit(int(n_stores))
    return a.agg(
        n.cast("long").alias("discovered_profiles"),
        F.count(F.lit(1)).alias("source_rows"),
        F.count_distinct(F.when(allowed, F.col("canonical_url"))).alias("pages_touched"),
        # keys, not rows: a repeated key is inserted once
        F.count_distinct(F.when(new_visit, F.struct("source_profile_id", "source_visit_id"))).alias("visits_inserted"),
        F.count_if(allowed).alias("filtered_allowed_rows"),
        F.count_if(F.col("status") == F.lit("denied")).alias("filtered_denied_rows"),
    )
