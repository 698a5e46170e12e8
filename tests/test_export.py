"""Repeatable export: equal rows in different layouts give equal parts and files."""

import glob
import hashlib
import tempfile

from pyspark.sql import functions as F

from pagetrail.sources import export


def files(path):
    """part -> digest of the bytes of its only file."""
    out = {}
    for f in glob.glob(f"{path}/parts/part=*/*.parquet"):
        part = int(f.split("part=")[1].split("/")[0])
        assert part not in out
        out[part] = hashlib.sha256(open(f, "rb").read()).hexdigest()
    return out


def table(spark, n=5000):
    return spark.range(n).selectExpr("(id * 7919) % 100003 as page_id", "concat('t', id % 13) as title", "if(id % 5 = 0, null, id) as seen", "array(id, null) as more")


def test_parts_are_byte_equal_after_repartition(spark):
    a, b = (tempfile.mkdtemp(prefix="pagetrail-export-") for _ in range(2))
    df = table(spark)
    first = export.export(df, f"file:{a}/x", ["page_id"], parts=6)
    second = export.export(df.repartition(11).orderBy(F.rand(3)), f"file:{b}/x", ["page_id"], parts=6)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    assert len(files(f"{a}/x")) == 6 and files(f"{a}/x") == files(f"{b}/x")
    sizes = [r.n_rows for r in first.collect()]
    assert sum(sizes) == 5000 and max(sizes) < 2 * min(sizes)
    assert export.differences(spark, f"file:{a}/x", f"file:{b}/x") == []


def test_a_change_shows_in_its_part_only(spark):
    a, b = (tempfile.mkdtemp(prefix="pagetrail-export-") for _ in range(2))
    df = table(spark)
    export.export(df, f"file:{a}/x", ["page_id"], parts=6)
    changed = df.withColumn("title", F.when(F.col("page_id") == 7919, "other").otherwise(F.col("title"))).filter("page_id <> 0")
    export.export(changed, f"file:{b}/x", ["page_id"], like=f"file:{a}/x")
    diff = export.differences(spark, f"file:{a}/x", f"file:{b}/x")
    assert 1 <= len(diff) <= 2 and {p for p in files(f"{a}/x") if files(f"{a}/x")[p] != files(f"{b}/x")[p]} == set(diff)


def test_repeated_rows_nulls_and_empty(spark):
    a = tempfile.mkdtemp(prefix="pagetrail-export-")
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (None, "y"), (2, "x")], "k long, v string")
    once = {r.part: (r.n_rows, r.digest) for r in export.export(rows, f"file:{a}/r", ["k"], parts=3).collect()}
    assert sum(n for n, _ in once.values()) == 5
    one, two = (export.digests(rows.limit(n)).first().digest for n in (1, 2))
    assert int(two) == 2 * int(one)  # a repeated row counts twice
    assert export.export(rows.limit(0), f"file:{a}/e", ["k"]).count() == 0
    assert export.read_manifest(spark, f"file:{a}/e") == {"keys": ["k"], "points": [], "parts": {}}
    null_or_text = spark.createDataFrame([(None,), ("null",), ("",)], "v string")
    assert len({r.h for r in null_or_text.select(export.row_hash(["v"]).alias("h")).collect()}) == 3


def test_split_points_are_taken_from_all_keys(spark):
    """More keys than the 20,000 that split points once came from, most of them close together; repeated keys count once."""
    keys = [i * i % 1_000_003 for i in range(30_000)] + [-i for i in range(1, 5_000)] + [10**12 + 7 * i for i in range(20_000)]
    df = spark.createDataFrame([(k,) for k in keys], "page_id long").repartition(7)
    want = sorted(set(keys))
    assert export.split_points(df, ["page_id"], 8) == [[want[len(want) * i // 8]] for i in range(1, 8)]
    a = tempfile.mkdtemp(prefix="pagetrail-export-")
    sizes = [r.n_rows for r in export.export(spark.createDataFrame([(k,) for k in want], "page_id long"), f"file:{a}/x", ["page_id"], parts=8).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1


def test_split_points_of_few_keys_and_of_several_columns(spark):
    few = spark.createDataFrame([(2, "b"), (None, "a"), (2, None), (2, "b"), (1, "z")], "k long, v string")
    want = [[None, "a"], [1, "z"], [2, None], [2, "b"]]
    for parts in (1, 2, 3, 4, 9):
        assert export.split_points(few, ["k", "v"], parts) == [want[4 * i // parts] for i in range(1, min(parts, 4))]
    assert export.split_points(few.limit(0), ["k", "v"], 8) == []
