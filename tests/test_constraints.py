"""Audit and purge from the declared constraints: every constraint has a planted violation."""

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import constraints as C

SCHEMAS = {
    "source_profiles": "source_profile_id long, browser string, profile_key string, label string",
    "pages": "page_id long, url string, host string, title string, first_seen_us long, last_seen_us long, normalization_version int",
    "visits": "visit_id long, page_id long, visited_at_us long, title_snapshot string, source_profile_id long, source_visit_id long",
    "bookmark_folders": "folder_id long, parent_folder_id long, title string, position int, created_at_us long, updated_at_us long",
    "bookmarks": "bookmark_id long, page_id long, folder_id long, status string, created_at_us long, updated_at_us long",
    "embedding_models": "model_id long, model_name string, dimensions int, is_active boolean",
    "page_embeddings": "page_id long, model_id long, content_hash string, updated_at_us long",
    "page_text": "page_id long, title string",
    "page_embedding_vec": "page_id long, embedding array<float>",
}
GOOD = {
    "source_profiles": [(1, "zen", "k1", None), (2, "firefox", "k2", None)],
    "pages": [(i, f"https://p{i}.test/", f"p{i}.test", f"t{i}", 1, 2, 1) for i in range(1, 7)],
    "visits": [(10 * p + s, p, 5, "t", s, p) for p in range(1, 7) for s in (1, 2)],
    "bookmark_folders": [(1, None, "root", 0, 1, 1), (2, 1, "a", 0, 1, 1), (3, 2, "b", 0, 1, 1), (4, 1, "c", 1, 1, 1)],
    "bookmarks": [(1, 1, 3, "active", 1, 1), (2, 2, None, "active", 1, 1), (3, 3, 4, "unread", 1, 1), (4, 4, 2, "active", 1, 1)],
    "embedding_models": [(1, "m1", 2, True), (2, "m2", 3, False)],
    "page_embeddings": [(1, 1, "h", 1), (2, 2, "h", 1)],
    "page_text": [(i, f"t{i}") for i in range(1, 7)],
    "page_embedding_vec": [(1, [0.0, 1.0]), (2, [1.0, 2.0])],
}


def frames(spark, **more):
    return {n: spark.createDataFrame(GOOD[n] + more.get(n, []), s) for n, s in SCHEMAS.items()}


def found(tables):
    return {(r["table"], r["constraint"], r["key"]): r["n"] for r in C.audit(tables).collect()}


def test_good_tables_pass(spark):
    assert found(frames(spark)) == {}
    C.gate(frames(spark))


def test_every_constraint_has_a_planted_violation(spark):
    bad = {
        "source_profiles": [(2, "zen", "k9", None), (None, None, None, None), (3, "zen", "k1", None)],
        "pages": [(6, "https://p6.test/", "h", "t", 1, 1, 1), (7, None, None, None, None, None, None), (None, "https://x.test/", "h", "t", 1, 1, 1)],
        "visits": [(11, 1, 5, "t", 1, 99), (900, 1, 5, "t", 1, 1), (901, 77, 5, "t", 55, 3), (902, 77, 5, "t", 55, 4), (None,) * 6],
        "bookmark_folders": [(4, 1, "again", 0, 1, 1), (5, 99, None, None, None, None), (None, None, "t", 1, 1, 1)],
        "bookmarks": [(4, 4, 88, "x", 1, 1), (5, 66, None, "x", 1, 1), (None, None, None, None, None, None)],
        "embedding_models": [(2, "m3", 4, True), (3, "m1", 0, False), (None, None, None, None)],
        "page_embeddings": [(2, 1, "h", 1), (50, 70, "h", 1), (None, None, None, None)],
        "page_text": [(1, "again"), (60, "t"), (None, None)],
        "page_embedding_vec": [(1, [0.0, 0.0]), (3, [1.0]), (61, [0.0] * 4), (None, None)],
    }
    got = found(frames(spark, **bad))
    want = {}
    for name, spec in C.SCHEMA.items():
        names = [f"{spec.key} unique", f"{spec.key} not null", *[f"{c} not null" for c in spec.not_null], *spec.checks]
        names += [f"({', '.join(u)}) unique" for u in spec.unique] + [f"{r.column} in {r.table}" for r in spec.references]
        for constraint in names:
            want[name, constraint] = True
    want["embedding_models", C.ONE_ACTIVE] = want["page_embedding_vec", C.DIMENSIONS] = True
    assert {(t, c) for t, c, _ in got} == set(want)
    assert got["visits", "page_id in pages", "77"] == 2 and got["visits", "source_profile_id in source_profiles", "55"] == 2
    assert got["visits", "(source_profile_id, source_visit_id) unique", "1|1"] == 2
    assert got["embedding_models", C.ONE_ACTIVE, "*"] == 2
    with pytest.raises(C.IntegrityError, match="unique|not null|in "):
        C.gate(frames(spark, **bad))


def test_a_table_is_scanned_once_per_key(spark):
    import tempfile

    tables, folder = {}, tempfile.mkdtemp(prefix="a")  # short: plans show the start of a path only
    for n, df in frames(spark).items():
        df.write.parquet(f"file:{folder}/{n}_table")
        tables[n] = spark.read.parquet(f"file:{folder}/{n}_table")
    plans, stored = [], C.stored

    def recording(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    C.stored = recording
    try:
        plans.append(C.audit(tables)._jdf.queryExecution().executedPlan().toString())
    finally:
        C.stored = stored
    keys = {"visits": 4, "pages": 2, "bookmarks": 3, "bookmark_folders": 2, "source_profiles": 2, "page_embeddings": 3, "page_text": 2}
    for name, most in keys.items():
        scans = sum(line.count(f"/{name}_table]") for p in plans for line in p.splitlines())
        assert 0 < scans <= most, (name, scans)


def rows(df, key):
    return sorted(r[key] for r in df.collect())


def test_purge_follows_the_references(spark):
    t = frames(spark)
    t["page_embeddings"] = t["page_embeddings"].filter("model_id = 1")
    doomed = {
        "pages": spark.createDataFrame([(2,), (2,), (999,), (None,)], "page_id long"),
        "source_profiles": spark.createDataFrame([(1,)], "source_profile_id long"),
        "bookmark_folders": spark.createDataFrame([(2,)], "folder_id long"),
        "embedding_models": spark.createDataFrame([(2,)], "model_id long"),
    }
    after = C.purge(t, doomed)
    assert rows(after["pages"], "page_id") == [1, 3, 4, 5, 6] and rows(after["source_profiles"], "source_profile_id") == [2]
    assert rows(after["visits"], "visit_id") == [12, 32, 42, 52, 62]
    assert rows(after["bookmark_folders"], "folder_id") == [1, 4]  # 3 lies below 2
    kept = {r.bookmark_id: (r.folder_id, r._nulled) for r in after["bookmarks"].collect()}
    assert kept == {1: (None, True), 3: (4, False), 4: (None, True)}
    assert rows(after["page_text"], "page_id") == [1, 3, 4, 5, 6] and rows(after["page_embedding_vec"], "page_id") == [1]
    assert rows(after["embedding_models"], "model_id") == [1] and rows(after["page_embeddings"], "page_id") == [1]
    assert found({n: df.drop("_nulled") for n, df in after.items()}) == {}
    counts = {r["table"]: (r["rows_before"], r["rows_after"], r["rows_nulled"]) for r in C.purge_counts(t, doomed).collect()}
    assert counts["bookmarks"] == (4, 3, 2) and counts["visits"] == (12, 5, 0)


def test_a_referenced_model_is_not_removable(spark):
    t = frames(spark)
    with pytest.raises(C.RestrictError, match="embedding_models 2"):
        C.purge(t, {"embedding_models": spark.createDataFrame([(2,)], "model_id long")})
    with pytest.raises(C.RestrictError):  # even if its pages go as well
        C.purge(t, {"embedding_models": spark.createDataFrame([(2,)], "model_id long"), "pages": t["pages"].select("page_id")})


def test_nothing_doomed(spark):
    t = frames(spark)
    after = C.purge(t, {"pages": t["pages"].limit(0), "bookmark_folders": t["bookmark_folders"].limit(0)})
    assert all(after[n].count() == len(GOOD[n]) and after[n].filter("_nulled").isEmpty() for n in t)


def test_gate_inside_the_ingest(spark, tmp_path):
    import sys

    sys.path.insert(0, str(__import__("pathlib").Path(__file__).parent))
    from test_pipeline_ingest import HILL, NOW, RIVER, length_encoder, make_store

    from pagetrail.plans.db_ingest import ingest_stores

    make_store(tmp_path / "zen", "river", RIVER)
    make_store(tmp_path / "fox", "hill", HILL)
    roots = {"zen": str(tmp_path / "zen"), "firefox": str(tmp_path / "fox")}
    models = spark.createDataFrame([(7, "four", 4, True), (8, "five", 5, False)], SCHEMAS["embedding_models"])
    options = {"as_of_us": NOW, "since_days": 2.0, "encoder": length_encoder, "batch_size": 2}
    t, summary, _ = ingest_stores(spark, roots, browsers=["zen", "opera"], models=models, verify=True, **options)
    assert summary.first()["discovered_profiles"] == 1 and {r.model_id for r in t.embedding_meta.collect()} == {7}
    both, _, _ = ingest_stores(spark, roots, browsers=["zen"], override=["zen", "firefox"], models=models, **options)
    assert both.profiles.count() == 2
    with pytest.raises(RuntimeError, match="active"):
        ingest_stores(spark, roots, models=models.withColumn("is_active", F.lit(True)), **options)
    wider = models.withColumn("is_active", F.col("model_id") == 8)
    with pytest.raises(ValueError, match="dimension"):
        ingest_stores(spark, roots, models=wider, existing=t, **options)
    t.documents = t.documents.unionByName(t.documents.withColumn("page_id", F.lit(5).cast("long")))
    with pytest.raises(C.IntegrityError, match="page_text"):
        ingest_stores(spark, roots, browsers=["zen"], models=models, existing=t, verify=True, **options)
