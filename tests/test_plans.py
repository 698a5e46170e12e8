"""Plan checks: the physical plans are the ones we intend, not just correct results."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_OK = {"encode_pages", "search_knn", "search_hybrid", "search_ann", "preview_ingest"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan_of(fn(spark, SF)) for name, fn in E.queries().items()}


def test_no_python_outside_encoder_and_vector_jobs(plans):
    for name, p in plans.items():
        if name in PYTHON_OK:
            continue
        for marker in ("PythonUDF", "MapInPandas", "ArrowEvalPython", "BatchEvalPython"):
            assert marker not in p, (name, marker)


def test_no_cartesian_products(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_top_k_per_group_is_limited_before_the_shuffle(plans):
    for name in ("recent_pages_by_host", "bookmarks_by_status", "bookmarks_by_folder", "page_timeline", "history_topk"):
        assert "WindowGroupLimit" in plans[name], name


def test_filters_and_pruning_reach_the_scan(spark):
    from pagetrail.sources import tables as tb

    p = plan_of(E.queries()["embedding_replace"](spark, SF))
    assert "PushedFilters: [IsNotNull(label), LessThan(label,5)]" in p
    p = plan_of(E.queries()["recent_visits"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in p
    # the look-back window reaches the events scan as a literal bound on the raw timestamp
    assert "GreaterThanOrEqual(ts," in p
    assert "GreaterThanOrEqual(ts," in plan_of(E.queries()["visits_in_range"](spark, SF))
    p = plan_of(tb.read(spark, SF, "documents").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in p


def test_dedupe_aggregates_partially_before_the_shuffle(plans):
    p = plans["dedupe_history"]
    assert "partial_min_by" in p
