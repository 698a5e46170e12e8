"""Snapshot dedupe, per-profile top-k and title clean-up."""

from pagetrail.operators import history

SNAP = "browser string, profile string, browser_rank int, id long, url string, title string, last_visit_date long"


def snap(spark, rows):
    return spark.createDataFrame(rows, SNAP)


def test_dedupe_newest_then_browser_profile_url(spark):
    rows = [
        ("zen", "a", 0, 1, "https://ex.com/p#1", "T1", 100),
        ("firefox", "b", 1, 2, "https://EX.com/p", "T2", 100),
        ("firefox", "a", 1, 3, "https://ex.com:443/p", "", 100),
        ("zen", "a", 0, 4, "https://other.test/", " Other\t", 50),
    ]
    out = {r["canonical_url"]: r for r in history.dedupe(history.history_entries(snap(spark, rows))).collect()}
    assert out["https://ex.com/p"]["browser"] == "firefox" and out["https://ex.com/p"]["profile"] == "a"
    assert out["https://ex.com/p"]["title"] == "(untitled)"
    assert out["https://other.test/"]["title"] == "Other"


def test_top_k_applies_before_invalid_urls_are_dropped(spark):
    rows = [
        ("zen", "a", 0, 1, "not a url", "x", 300),
        ("zen", "a", 0, 2, "https://a.test/", "a", 200),
        ("zen", "a", 0, 3, "https://b.test/", "b", 100),
        ("zen", "a", 0, 4, "   ", "blank", 400),
    ]
    got = history.history_entries(snap(spark, rows), limit_per_profile=2).collect()
    assert [r["url"] for r in got] == ["https://a.test/"]


def test_preview_order_and_cap(spark):
    rows = [("zen", "a", 0, i, f"https://h{i}.test/", f"t{i}", 1000 - i) for i in range(10)]
    out = history.preview_entries(snap(spark, rows), rules=["-h3.test"], max_items=4).collect()
    assert [r["url"] for r in out] == ["https://h0.test/", "https://h1.test/", "https://h2.test/", "https://h4.test/"]


def test_partitioning_does_not_change_dedupe(spark):
    rows = [("zen" if i % 2 else "firefox", f"p{i % 3}", i % 2, i, f"https://h{i % 17}.test/x", f"t{i}", i % 5)
            for i in range(300)]
    df = snap(spark, rows)
    a = sorted(map(tuple, history.dedupe(history.history_entries(df.repartition(1))).collect()))
    b = sorted(map(tuple, history.dedupe(history.history_entries(df.repartition(7))).collect()))
    assert a == b


def test_deep_folder_chain_and_cycle(spark):
    from pagetrail.operators import history

    chain = [(i, i - 1 if i else None) for i in range(200)]
    rows = chain + [(1000, 1001), (1001, 1000), (1002, 1001), (2000, 99999)]
    df = spark.createDataFrame(rows, "folder_id long, parent_folder_id long")
    out = {(r.folder_id, r.ancestor_id): r.depth for r in history.folder_tree(df).collect()}
    assert all(out[i, j] == i - j for i in range(200) for j in range(i + 1))
    assert out[1002, 1000] == 2 and out[1000, 1001] == 1 and out[1000, 1000] == 0 and out[2000, 99999] == 1
    assert len(out) == 200 * 201 // 2 + 2 + 2 + 3 + 2 and (99999, 99999) not in out
