"""Queries without a window or cap of their own answer over whole tables."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from pagetrail.operators import history
from pagetrail.plans import catalog as C
from pagetrail.sources import tables as tb

SF = "/root/testdata/sf0.01"


def test_every_visit_and_entry_is_there(spark):
    q = E.queries()
    every = C._allowed(C._annotated(spark, SF, None))
    kept = q["policy_filter_all"](spark, SF).count()
    assert q["policy_filter"](spark, SF).count() == kept <= every.count()
    cut = C._cutoff_literal(spark, SF, C.INGEST_DAYS)
    merged = q["visit_insert_ignore_all"](spark, SF)
    assert {r.is_new: (r.lo < cut, r.hi < cut) for r in merged.groupBy("is_new").agg(F.min("visited_at_us").alias("lo"), F.max("visited_at_us").alias("hi")).collect()} == {
        False: (True, True),
        True: (False, False),
    }
    entries = history.preview_entries(tb.history_snapshot(spark, SF), rules=C.RULES).count()
    assert entries > C.MAX_ITEMS
    assert q["snapshot_summary_all"](spark, SF).first().deduped_row_count == entries
    assert q["preview_ingest"](spark, SF).count() == entries
