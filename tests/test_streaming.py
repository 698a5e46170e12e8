"""Incremental ingest: several arriving files end in the same state as one batch run."""

import os
import tempfile

from pyspark.sql import functions as F

from pagetrail.operators import ingest
from pagetrail.sources import snapshot, tables
from pagetrail.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_incremental_equals_one_batch(spark):
    visits = tables.visits(spark, SF).select(
        "browser", "profile", "browser_rank", "store_path", "visit_id", "place_id", "visit_date"
    )
    places = tables.places(spark, SF)
    work = tempfile.mkdtemp(prefix="pagetrail-stream-")
    src, wh = os.path.join(work, "in"), os.path.join(work, "wh")
    # three arrivals, each a time slice (titles then resolve the same way as one run)
    cuts = [r[0] for r in visits.select(F.percentile_approx("visit_date", [0.33, 0.66])).collect()][0]
    parts = [
        visits.filter(F.col("visit_date") < cuts[0]),
        visits.filter((F.col("visit_date") >= cuts[0]) & (F.col("visit_date") < cuts[1])),
        visits.filter(F.col("visit_date") >= cuts[1]),
    ]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(src, f"arrival={i}"))
        q = incremental.start(spark, source_dir=os.path.join(src, f"arrival={i}"), places=places, warehouse=wh,
                              checkpoint_location=os.path.join(work, f"ckpt{i}"))
        q.awaitTermination(300)
    pages = snapshot.read_latest(spark, wh, "pages")
    vis = snapshot.read_latest(spark, wh, "visits")

    annotated = ingest.annotated_visit_rows(visits, places, None)
    allowed = annotated.filter(F.col("status") == "allowed")
    one_pages = ingest.merge_pages(None, ingest.page_batch(allowed))
    one_visits = ingest.visit_batch(allowed)

    cols = ["page_id", "url", "host", "first_seen_us", "last_seen_us"]
    assert sorted(map(tuple, pages.select(cols).collect())) == sorted(map(tuple, one_pages.select(cols).collect()))
    assert vis.count() == one_visits.count()
    assert snapshot.versions(wh, "pages") == [1, 2, 3]


def test_a_restart_consumes_no_file_twice(spark):
    visits = tables.visits(spark, SF).select(
        "browser", "profile", "browser_rank", "store_path", "visit_id", "place_id", "visit_date"
    ).filter("visit_id < 40")
    work = "file:" + tempfile.mkdtemp(prefix="pagetrail-restart-")
    visits.coalesce(1).write.parquet(f"{work}/in")
    for _ in range(2):
        q = incremental.start(spark, source_dir=f"{work}/in", places=tables.places(spark, SF), warehouse=f"{work}/wh",
                              checkpoint_location=f"{work}/ckpt")
        q.awaitTermination(300)
    assert snapshot.versions(f"{work}/wh", "visits") == [1]
    assert snapshot.read_latest(spark, f"{work}/wh", "visits").count() == visits.count()
