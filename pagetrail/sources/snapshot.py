"""Versioned Parquet snapshots.

A merge never overwrites the table it reads: each write goes to a new
``<base>/<table>/v=<n>`` directory and readers are pointed at the newest
complete version (Spark's ``_SUCCESS`` marker). Writes are range-sorted on a
total key so repeated exports are byte-for-byte reproducible in row order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .lake import Lake

SORT_KEYS = {
    "pages": ["last_seen_us", "page_id"],
    "visits": ["visited_at_us", "source_profile_id", "source_visit_id"],
    "profiles": ["profile_key"],
    "documents": ["page_id"],
    "embedding_meta": ["page_id"],
    "vectors": ["page_id"],
}


def _folder(base: str, table: str, version: int | None = None) -> str:
    return "/".join([base.rstrip("/"), table] + ([] if version is None else [f"v={version}"]))


def versions(base: str, table: str, spark: SparkSession | None = None) -> list[int]:
    """Complete versions, listed with Spark's file system API (any store that Spark reads); of a lake, those that hold the table."""
    spark = spark or SparkSession.builder.getOrCreate()
    lake = Lake(spark, base)
    if committed := lake.versions():
        return [v for v in committed if table in lake.tables_at(v)]
    done = spark._jvm.org.apache.hadoop.fs.Path(_folder(base, table), "v=*/_SUCCESS")
    statuses = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    names = (re.fullmatch(r"v=(\d+)", s.getPath().getParent().getName()) for s in statuses)
    return sorted(int(m.group(1)) for m in names if m)


def write_version(df: DataFrame, base: str, table: str, sort_keys: list[str] | None = None) -> str:
    """Write the next version of ``table``; returns its path."""
    path = _folder(base, table, (versions(base, table, df.sparkSession) or [0])[-1] + 1)
    keys = sort_keys or SORT_KEYS.get(table)
    out = df.orderBy(*keys) if keys else df
    out.write.mode("errorifexists").parquet(path)
    return path


def read_latest(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    vs = versions(base, table, spark)
    if not vs:
        return None
    lake = Lake(spark, base)
    if lake.versions():
        return lake.read(table)
    return spark.read.parquet(_folder(base, table, vs[-1]))
