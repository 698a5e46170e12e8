"""Streaming ingest straight from live profile stores."""

import sqlite3
import tempfile
from pathlib import Path

import pytest

from pagetrail.operators import ingest
from pagetrail.sources import profile_store
from pagetrail.sources.lake import Lake
from pagetrail.streaming import incremental

COUNT = 40


def add(root: Path, profile: str, first: int, n: int, made: bool = False):
    """Visits first..first+n-1 of a store; ten pages a profile, titles change with time."""
    folder = root / profile
    folder.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(folder / "places.sqlite") as conn:
        if made:
            conn.execute("CREATE TABLE moz_places (id INTEGER PRIMARY KEY, url TEXT, title TEXT)")
            conn.execute("CREATE TABLE moz_historyvisits (id INTEGER PRIMARY KEY, place_id INTEGER, visit_date INTEGER)")
            urls = [(i, f"https://shared.test/{i}" if i < 5 else f"https://{profile}.test/{i}", f"{profile} {i}") for i in range(10)]
            conn.executemany("INSERT INTO moz_places VALUES (?, ?, ?)", urls + [(10, None, "none"), (11, "  ", "blank"), (12, "about:blank", None)])
        conn.executemany("INSERT INTO moz_historyvisits VALUES (?, ?, ?)", [(i, i % 13, i * 10**9 + len(profile)) for i in range(first, first + n)])
    conn.close()


@pytest.fixture()
def live():
    with tempfile.TemporaryDirectory(prefix="pagetrail-live-") as tmp:
        yield Path(tmp)


def run(spark, live):
    q = incremental.start_from_stores(
        spark, roots=[("zen", str(live / "zen")), ("firefox", str(live / "fox"))], warehouse=f"file:{live}/lake",
        rules=["-p2.test"], checkpoint_location=f"file:{live}/checkpoint",
    )
    q.awaitTermination(300)
    assert q.exception() is None


def test_new_visits_arrive_once_across_restarts_and_equal_one_batch(spark, live):
    add(live / "zen", "p1", 1, COUNT, made=True)
    run(spark, live)
    lake = Lake(spark, f"file:{live}/lake")
    assert lake.versions() == [1]
    run(spark, live)  # nothing new
    assert lake.versions() == [1]
    add(live / "zen", "p1", COUNT + 1, 7)
    add(live / "fox", "p2", 1, COUNT, made=True)  # a store that appears later
    (live / "zen" / "broken").mkdir()
    (live / "zen" / "broken" / "places.sqlite").write_bytes(b"no database" * 50)
    run(spark, live)
    add(live / "fox", "p2", COUNT + 1, 3)
    run(spark, live)
    assert lake.versions() == [1, 2, 3]

    places, visits, errors = profile_store.read_stores(spark, [("zen", str(live / "zen")), ("firefox", str(live / "fox"))])
    annotated = ingest.annotated_visit_rows(visits, places, None, ["-p2.test"], keys=("browser", "profile", "place_id"))
    allowed = annotated.filter("status = 'allowed'")
    want_visits = ingest.visit_batch(allowed).select(*ingest.VISIT_COLUMNS)
    got_visits = lake.read("visits", columns=ingest.VISIT_COLUMNS)
    assert sorted(map(tuple, got_visits.collect())) == sorted(map(tuple, want_visits.collect()))
    want_pages = ingest.merge_pages(None, ingest.page_batch(allowed, "newest"))
    assert sorted(map(tuple, lake.read("pages", columns=ingest.PAGE_COLUMNS).collect())) == sorted(map(tuple, want_pages.collect()))
    assert got_visits.count() == got_visits.select("source_profile_id", "source_visit_id").distinct().count() > 2 * COUNT * 0.5
    assert {r.browser for r in lake.read("profiles").collect()} == {"zen", "firefox"} and errors.count() == 1


def test_offsets_and_ranges(live, monkeypatch):
    monkeypatch.setattr(profile_store, "SPLIT_IDS", 16)
    add(live / "zen", "p1", 1, COUNT, made=True)
    reader = profile_store._StreamReader({"roots": f'[["zen", "{live}/zen"]]'})
    path = str((live / "zen" / "p1" / "places.sqlite").resolve())
    assert reader.initialOffset() == {} and reader.latestOffset() == {path: COUNT}
    ranges = [p.value[1:] for p in reader.partitions({}, {path: COUNT})]
    assert ranges == [(0, 16), (16, 32), (32, COUNT)]
    assert [p.value[1:] for p in reader.partitions({path: 38}, {path: COUNT})] == [(38, COUNT)]
    assert reader.partitions({path: COUNT}, {path: COUNT}) == []
    assert [p.value[1:] for p in reader.partitions({path: 99}, {path: 3})] == [(0, 3)]  # the store was made anew
    ids = [i for p in reader.partitions({}, {path: COUNT}) for b in reader.read(p) for i in b.column(4).to_pylist()]
    assert ids == list(range(1, COUNT + 1))
    (live / "zen" / "p1" / "places.sqlite").write_bytes(b"broken now" * 100)
    assert reader.latestOffset() == {path: COUNT}  # keeps its offset


def test_a_store_that_breaks_half_way_gives_no_rows(spark, live, monkeypatch):
    add(live / "zen", "good", 1, 5, made=True)
    add(live / "zen", "odd", 1, 5, made=True)
    with sqlite3.connect(live / "zen" / "odd" / "places.sqlite") as conn:
        conn.execute("UPDATE moz_historyvisits SET visit_date = 'not a number' WHERE id = 5")
    conn.close()
    _, visits, errors = profile_store.read_stores(spark, [("zen", str(live / "zen"))])
    assert {r.profile for r in visits.collect()} == {"good"} and [r.profile for r in errors.collect()] == ["odd"]
