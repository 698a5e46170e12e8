"""Incremental ingest (T1): of arriving visit files, or straight from live profile stores.

Each micro-batch runs the same merge as the batch ingest (page upsert,
insert-or-ignore visits, profiles) against a lake (``sources.lake``) and
touches only what it must:

* pages lie in hash buckets of their id; the buckets of the batch's pages are
  read, merged and written anew;
* visits lie by day. New visits are added to their days; an older row with the
  same key may lie in another day, so the lake also keeps, per day and profile,
  the range of visit ids (``visit_ranges``). Only days whose range meets that of
  the batch are read for the anti-join;
* one manifest commits all of it: a failure in between leaves the pages and visits
  of the version before.

The manifest also records the stream and its epoch. An epoch replayed after a
restart is recognised and skipped; the merges are idempotent besides.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import profile_store
from ..sources.lake import Commit, Lake, hash_bucket

VISIT_FILE_SCHEMA = (
    "browser string, profile string, browser_rank int, store_path string, "
    "visit_id long, place_id long, visit_date long"
)
DAY_US = 86_400_000_000
PAGE_BUCKETS = 64
PROFILE_BUCKETS = 8
VISIT_KEY = ("source_profile_id", "source_visit_id")


def day_of(micros: str | Column = "visited_at_us") -> Column:
    c = F.col(micros) if isinstance(micros, str) else micros
    return F.floor(c / F.lit(DAY_US)).cast("int")


def numbers(df: DataFrame) -> list[int]:
    """Distinct values of a partition column (days or buckets, so few)."""
    return sorted(r[0] for r in df.distinct().collect())


def merge_page_batch(commit: Commit, allowed: DataFrame, title_policy: str) -> None:
    """Upsert into the buckets of the batch's pages."""
    buckets = commit.setting("page_buckets", PAGE_BUCKETS)
    batch = commit.stage(ingest.page_batch(allowed, title_policy).withColumn("page_id", ingest.page_id_of("url")))
    touched = numbers(batch.select(hash_bucket("page_id", buckets)))
    merged = ingest.merge_pages(commit.read("pages", touched), batch, title_policy)
    commit.replace("pages", merged.withColumn("bucket", hash_bucket("page_id", buckets)), "bucket", touched, ("last_seen_us", "page_id"))


def days_that_may_hold(commit: Commit, batch: DataFrame) -> list[int]:
    """Days of the lake whose range of visit ids meets the batch's, profile by profile."""
    asked = batch.groupBy("source_profile_id").agg(F.min("source_visit_id").alias("_lo"), F.max("source_visit_id").alias("_hi"))
    known = commit.read("visit_ranges")
    if known is None:
        return []
    meets = (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo"))
    return numbers(known.join(asked, "source_profile_id").filter(meets).select("day"))


def merge_visit_batch(commit: Commit, allowed: DataFrame) -> None:
    """Add the visits whose key the lake does not hold."""
    batch = commit.stage(ingest.visit_batch(allowed).withColumn("day", day_of()))
    existing = commit.read("visits", days_that_may_hold(commit, batch), list(VISIT_KEY))
    new = batch if existing is None else batch.join(existing, list(VISIT_KEY), "left_anti")
    commit.append("visits", new.select(*ingest.VISIT_COLUMNS, "day"), "day", ("visited_at_us", *VISIT_KEY))
    added = commit.appended("visits")
    if added is not None:
        ranges = added.groupBy("source_profile_id", "day").agg(F.min("source_visit_id").alias("lo"), F.max("source_visit_id").alias("hi"))
        commit.append("visit_ranges", ranges.withColumn("bucket", hash_bucket("source_profile_id", PROFILE_BUCKETS)), "bucket", ("source_profile_id", "day"))


def merge_profiles(commit: Commit, annotated: DataFrame) -> None:
    """Add the profiles that the lake does not hold."""
    known = commit.read("profiles")
    found = ingest.register_profiles(None if known is None else known.drop("bucket"), ingest.stores_of(annotated))
    new = found.filter("is_new").drop("is_new").withColumn("bucket", hash_bucket("source_profile_id", PROFILE_BUCKETS))
    commit.append("profiles", new, "bucket", ("profile_key",))


def merge_annotated(
    spark: SparkSession, annotated: DataFrame, warehouse: str, *, mark: tuple[str, int] | None = None, title_policy: str = "reference"
) -> Commit | None:
    """Merge annotated visits (``ingest.annotated_visit_rows``) into the lake at ``warehouse`` as one commit.

    ``mark``: (stream, epoch); None is returned for an epoch that the lake has already.
    """
    commit = Lake(spark, warehouse).begin()
    if mark and commit.marks.get(mark[0], -1) >= mark[1]:
        return None
    annotated = commit.stage(annotated)
    allowed = annotated.filter(F.col("status") == F.lit("allowed"))
    merge_page_batch(commit, allowed, title_policy)
    merge_visit_batch(commit, allowed)
    merge_profiles(commit, annotated)
    commit.publish({mark[0]: mark[1]} if mark else None)
    return commit


def merge_batch(
    spark: SparkSession,
    batch: DataFrame,
    places: DataFrame,
    warehouse: str,
    rules=(),
    keys: tuple[str, ...] = ("place_id",),
    mark: tuple[str, int] | None = None,
    title_policy: str = "reference",
) -> Commit | None:
    """Merge one batch of visit rows into the lake."""
    annotated = ingest.annotated_visit_rows(batch, places, None, rules, keys=keys)
    return merge_annotated(spark, annotated, warehouse, mark=mark, title_policy=title_policy)


def visits_between(lake: Lake, start_us: int, end_us: int) -> DataFrame | None:
    """Visits of [start, end) from the lake (H4); reads only the days in between."""
    days = [d for d in lake.parts("visits") if start_us // DAY_US <= d <= (end_us - 1) // DAY_US]
    found = lake.read("visits", days, columns=ingest.VISIT_COLUMNS)
    at = F.col("visited_at_us")
    return None if found is None else found.filter((at >= F.lit(int(start_us))) & (at < F.lit(int(end_us))))


def _run(stream: DataFrame, process, checkpoint_location: str):
    def each(batch: DataFrame, epoch_id: int) -> None:
        if not batch.isEmpty():
            process(batch, (checkpoint_location, int(epoch_id)))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()


def start(
    spark: SparkSession,
    *,
    source_dir: str,
    places: DataFrame,
    warehouse: str,
    rules=(),
    keys: tuple[str, ...] = ("place_id",),
    checkpoint_location: str,
    max_files_per_trigger: int | None = None,
    title_policy: str = "reference",
):
    """Start the stream over visit files with an ``availableNow`` trigger; returns the StreamingQuery.

    ``checkpoint_location`` belongs to this stream alone and is given again on a
    restart: it holds the record of the files already consumed.
    """
    reader = spark.readStream.schema(VISIT_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.parquet(source_dir)
    return _run(stream, lambda batch, mark: merge_batch(spark, batch, places, warehouse, rules, keys, mark, title_policy), checkpoint_location)


def start_from_stores(
    spark: SparkSession,
    *,
    roots: list[tuple[str, str]],
    warehouse: str,
    rules=(),
    checkpoint_location: str,
    title_policy: str = "newest",
):
    """Start the stream over the live profile stores below ``roots`` with an ``availableNow`` trigger.

    Offsets are the last visit id of each store, kept in the stream's
    checkpoint; stores that appear later join the next run.
    """
    profile_store.register(spark)
    stream = spark.readStream.format(profile_store.STREAM_FORMAT).option("roots", json.dumps(roots)).load()

    def process(batch: DataFrame, mark: tuple[str, int]) -> None:
        rows = batch.filter(F.trim("raw_url") != F.lit(""))
        merge_annotated(spark, ingest.annotate_visits(rows, rules), warehouse, mark=mark, title_policy=title_policy)

    return _run(stream, process, checkpoint_location)
