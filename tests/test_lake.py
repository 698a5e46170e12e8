"""Lake commits: partitions touched, both tables at once, append and compaction, vacuum, and the merge on top of them."""

import tempfile

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import ingest
from pagetrail.sources import lake as lakes
from pagetrail.sources.lake import Conflict, Lake
from pagetrail.streaming import incremental

DAY = incremental.DAY_US
COLUMNS = "browser string, profile string, browser_rank int, store_path string, source_visit_id long, raw_url string, raw_title string, visited_at_us long"


@pytest.fixture()
def base():
    return "file:" + tempfile.mkdtemp(prefix="pagetrail-lake-")


def visits(spark, rows):
    """(profile, visit id, url, title, day, microsecond of the day) as annotated visits."""
    filled = [("zen", p, 0, f"/s/{p}/places.sqlite", i, u, t, day * DAY + us) for p, i, u, t, day, us in rows]
    return ingest.annotate_visits(spark.createDataFrame(filled, COLUMNS))


def state(lake, version=None):
    pages = lake.read("pages", version=version).drop("bucket").orderBy("url").collect()
    kept = lake.read("visits", version=version).drop("day").orderBy("source_profile_id", "source_visit_id").collect()
    return [tuple(r) for r in pages], [tuple(r) for r in kept]


def one_batch(spark, rows, title_policy):
    allowed = visits(spark, rows).filter("status = 'allowed'")
    pages = ingest.merge_pages(None, ingest.page_batch(allowed, title_policy)).orderBy("url").collect()
    kept = ingest.visit_batch(allowed).select(*ingest.VISIT_COLUMNS).orderBy("source_profile_id", "source_visit_id").collect()
    return [tuple(r) for r in pages], [tuple(r) for r in kept]


def test_commit_reads_and_writes_only_its_partitions(spark, base):
    lake = Lake(spark, base)
    first = lake.begin()
    first.replace("t", spark.range(100).selectExpr("id", "cast(id % 10 as int) as part"), "part")
    assert first.publish() == 1
    second = lake.begin()
    old = second.read("t", [3, 4])
    assert old.count() == 20 and all("part=3" in f or "part=4" in f for f in old.inputFiles())
    second.replace("t", old.filter("part = 3").withColumn("id", F.col("id") + 1000), "part", [3, 4])
    assert lake.read("t").count() == 100  # not published
    second.publish()
    assert second.read_parts == {"t": [3, 4]} and second.written_parts == {"t": [3]}
    before, after = (lake.manifest(v)["tables"]["t"]["parts"] for v in (1, 2))
    assert {p for p in before if before[p] != after.get(p)} == {"3", "4"} and "4" not in after
    assert lake.read("t").count() == 90 and lake.read("t", [3]).agg(F.min("id")).first()[0] == 1003
    assert lake.read("t", [4]) is None and lake.read("t", [99]) is None and lake.read("none") is None
    with pytest.raises(ValueError, match="outside"):
        lake.begin().replace("t", spark.range(3).selectExpr("id", "cast(id as int) as part"), "part", [0])
    with pytest.raises(ValueError, match="columns differ"):
        lake.begin().append("t", spark.range(3).selectExpr("id as other", "cast(id as int) as part"), "part")


def test_two_writers_of_one_version(spark, base):
    lake = Lake(spark, base)
    a, b = lake.begin(), lake.begin()
    for commit in (a, b):
        commit.append("t", spark.range(3).selectExpr("id", "0 as part"), "part")
    a.publish()
    with pytest.raises(Conflict):
        b.publish()
    assert lake.versions() == [1] and lake.read("t").count() == 3


def test_appends_are_compacted_and_vacuumed(spark, base, monkeypatch):
    monkeypatch.setattr(lakes, "MAX_FOLDERS", 2)
    lake = Lake(spark, base)
    for i in range(4):
        c = lake.begin()
        c.append("t", spark.createDataFrame([(i, 0)] + ([(i, 9)] if i == 1 else []), "id long, part int"), "part")
        c.publish()
    held = lake.manifest()["tables"]["t"]["parts"]
    assert len(held["0"]) == 2 and len(held["9"]) == 1
    assert sorted(r.id for r in lake.read("t", [0]).collect()) == [0, 1, 2, 3]
    assert lake.read("t", version=2).count() == 3
    gone = lake.vacuum(keep=1)
    assert len(gone) == 2 and lake.versions() == [4] and lake.read("t").count() == 5  # the second folder still holds partition 9
    assert lake.vacuum(keep=1) == []


def test_batches_of_days_touch_only_their_partitions_and_equal_one_batch(spark, base):
    rows = [(f"p{i % 2}", i, f"https://h{i % 7}.test/{i % 13}", f"t{i}", i // 50, i % 50) for i in range(300)]
    lake = Lake(spark, base)
    for day in (0, 1, 2, 4, 5):
        incremental.merge_annotated(spark, visits(spark, [r for r in rows if r[4] == day]), base, title_policy="newest")
    # a late day between: its ids lie between those of days 2 and 4, so no other day needs to be read
    late = incremental.merge_annotated(spark, visits(spark, [r for r in rows if r[4] == 3]), base, title_policy="newest")
    assert late.read_parts["visits"] == [] and late.written_parts["visits"] == [3]
    assert state(lake) == one_batch(spark, rows, "newest")
    # one page of one day again: the same key, and one new visit
    again = [rows[120], ("p0", 9000, rows[120][2], "seen again", 5, 77)]
    c = incremental.merge_annotated(spark, visits(spark, again), base, title_policy="newest")
    assert c.written_parts["visits"] == [5] and len(c.written_parts["pages"]) == 1 == len(c.read_parts["pages"])
    assert state(lake) == one_batch(spark, rows + again[1:], "newest")
    found = incremental.visits_between(lake, 2 * DAY + 10, 4 * DAY)
    assert all("day=2" in f or "day=3" in f for f in found.inputFiles()) and found.count() == 40 + 50
    assert incremental.visits_between(lake, 50 * DAY, 60 * DAY) is None


def test_a_known_key_with_another_time_is_ignored(spark, base):
    incremental.merge_annotated(spark, visits(spark, [("a", 5, "https://x.test/", "x", 1, 0), ("a", 9, "https://x.test/", "x", 4, 0), ("b", 7, "https://x.test/", "x", 9, 0)]), base)
    c = incremental.merge_annotated(spark, visits(spark, [("a", 5, "https://y.test/", "y", 7, 0), ("a", 6, "https://y.test/", "y", 7, 1)]), base)
    assert c.read_parts["visits"] == [1]
    kept = {(r.source_visit_id, r.visited_at_us // DAY) for r in Lake(spark, base).read("visits").collect()}
    assert kept == {(5, 1), (9, 4), (7, 9), (6, 7)}
    assert Lake(spark, base).read("profiles").count() == 2


def test_failure_between_the_tables_leaves_the_old_pair(spark, base, monkeypatch):
    lake = Lake(spark, base)
    incremental.merge_annotated(spark, visits(spark, [("a", 1, "https://x.test/", "x", 1, 0)]), base)
    before = state(lake)
    more = visits(spark, [("a", 2, "https://x.test/", "newer", 2, 0)])

    def fails(*_):
        raise RuntimeError("lost between pages and visits")

    with monkeypatch.context() as m:
        m.setattr(incremental, "merge_visit_batch", fails)
        with pytest.raises(RuntimeError, match="lost between"):
            incremental.merge_annotated(spark, more, base)
    assert lake.versions() == [1] and state(lake) == before
    incremental.merge_annotated(spark, more, base)
    assert state(lake)[0][0][3] == "newer" and len(state(lake)[1]) == 2 and state(lake, 1) == before


def test_a_replayed_epoch_is_skipped(spark, base):
    one = visits(spark, [("a", 1, "https://x.test/", "x", 1, 0)])
    assert incremental.merge_annotated(spark, one, base, mark=("s", 0)).version == 1
    assert incremental.merge_annotated(spark, one, base, mark=("s", 0)) is None
    assert incremental.merge_annotated(spark, one, base, mark=("other", 0)).version == 2
    assert Lake(spark, base).manifest()["marks"] == {"s": 0, "other": 0}


def test_a_batch_without_allowed_visits(spark, base):
    c = incremental.merge_annotated(spark, visits(spark, [("a", 1, "no url", "x", 1, 0)]), base)
    assert c.version == 1 and Lake(spark, base).read("pages") is None and Lake(spark, base).read("visits") is None
    incremental.merge_annotated(spark, visits(spark, [("a", 2, "https://x.test/", "x", 1, 0)]), base)
    assert Lake(spark, base).read("pages").count() == 1
