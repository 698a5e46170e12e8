"""Repeatable export (S8): the same rows give the same files, whatever the layout of their input.

Rows are ordered by their key columns and then by all others, and cut at split
points into parts. Split points come from the content: all distinct keys are
sorted and numbered, and taken at even steps; they are kept in a manifest, and an
export into a folder that has a manifest uses its split points, so parts stay
comparable between versions. Every part is one sorted file, and has a digest
that does not depend on order: number of rows, and the sum of a 60-bit hash of
each row. Two exports can be compared part by part without reading rows.

A part holds whole keys. A key that many rows share stays in one part, so keys should be
nearly unique (pages by id, visits by time and id).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import _Files
from .scratch import stored

MANIFEST = "manifest.json"


def _text(column: Column) -> Column:
    """A value as JSON text, null distinct from any value."""
    return F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})


def row_hash(columns: list[str]) -> Column:
    """60 bits of the SHA-256 of a row's values by column name."""
    whole = F.concat_ws("\n", *[_text(F.col(c)) for c in sorted(columns)])
    return F.conv(F.substring(F.sha2(whole, 256), 1, 15), 16, 10).cast("long")


def split_points(df: DataFrame, keys: list[str], parts: int) -> list[list]:
    """At most ``parts - 1`` keys that cut the distinct keys of ``df`` into parts of equal size; the same for the same rows.

    All distinct keys are stored in order, in one run a task. The lengths of the runs before it and a key's place in
    its own run give the key's number; only the lengths of the runs and the cutting keys reach the driver.
    """
    distinct = stored(df.select(*keys).distinct(), "export_keys")
    place = F.monotonically_increasing_id()  # run in the upper bits, place in the run in the lower 33
    ordered = stored(distinct.orderBy(*keys).select(place.alias("place"), F.struct(*keys).alias("key")), "ordered_keys")
    runs = sorted(map(tuple, ordered.groupBy(F.shiftright("place", 33)).agg(F.count(F.lit(1))).collect()))
    n = sum(length for _, length in runs)
    places, before = [], 0
    for run, length in runs:
        for cut in [n * i // parts for i in range(1, min(parts, n))]:
            if before <= cut < before + length:
                places.append((run << 33) + cut - before)
        before += length
    if not places:
        return []
    found = {r.place: list(r.key) for r in ordered.filter(F.col("place").isin(places)).collect()}
    return [found[p] for p in places]


def part_of(keys: list[str], points: list[list], schema) -> Column:
    """Number of split points that are not above the row's key."""
    key = F.struct(*keys)
    literal = [F.struct(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(keys, p)]) for p in points]
    return sum((F.when(p <= key, 1).otherwise(0) for p in literal), F.lit(0)) if literal else F.lit(0)


def digests(df: DataFrame, part: Column | None = None) -> DataFrame:
    """part, n_rows, digest: equal for equal rows in any order."""
    rows = df.select((F.lit(0) if part is None else part).cast("int").alias("part"), row_hash(df.columns).alias("h"))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    files = _Files(spark, path)
    return json.loads(files.read(f"{path}/{MANIFEST}")) if files.exists(f"{path}/{MANIFEST}") else None


def export(df: DataFrame, path: str, keys: list[str], parts: int = 8, like: str | None = None) -> DataFrame:
    """Write ``df`` as sorted Parquet parts below ``path``; returns part, n_rows, digest.

    ``like``: an earlier export whose split points are used, so that parts can be compared.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    earlier = read_manifest(spark, like.rstrip("/")) if like else None
    if earlier and earlier["keys"] != keys:
        raise ValueError(f"the earlier export is split by {earlier['keys']}")
    points = earlier["points"] if earlier else [[str(v) if v is not None else None for v in p] for p in split_points(df, keys, parts)]
    part = part_of(keys, points, df.schema)
    rest = [c for c in df.columns if c not in keys]
    placed = df.withColumn("part", part.cast("int")).repartition(max(1, len(points) + 1), "part")
    placed.sortWithinPartitions("part", *keys, *rest).write.partitionBy("part").parquet(f"{path}/parts")
    found = stored(digests(df, part), "export_digests")
    rows = {r.part: [r.n_rows, r.digest] for r in found.collect()}  # one row a part
    _Files(spark, path).write(f"{path}/{MANIFEST}", json.dumps({"keys": keys, "points": points, "parts": rows}, sort_keys=True))
    return found


def differences(spark: SparkSession, path: str, other: str) -> list[int]:
    """Parts whose rows differ between two exports with the same split points."""
    a, b = read_manifest(spark, path.rstrip("/")), read_manifest(spark, other.rstrip("/"))
    if a["points"] != b["points"] or a["keys"] != b["keys"]:
        raise ValueError("exports with different split points")
    return sorted(int(p) for p in set(a["parts"]) | set(b["parts"]) if a["parts"].get(p) != b["parts"].get(p))
