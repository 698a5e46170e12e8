"""Driver contract: entry, registered queries and their oracles."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["browser", "profile", "title", "url", "canonical_url", "last_visit_date"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = {"search_ann", "encode_pages", "preview_ingest"}
    optional = set(E._llm()[0])  # the training-data queries have tests of their own, and may not be installed
    assert set(E.oracle_sql()) - optional | rows_only == set(E.queries()) - optional


def test_some_queries_against_duckdb(spark):
    import duckdb

    from pagetrail.sources.tables import TABLES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["dedupe_history", "policy_trace", "page_upsert", "search_bm25"]:
        spark_rows = E.queries()[name](spark, sf).count()
        duck_rows = con.execute(f"SELECT count(*) FROM ({E.oracle_sql()[name]})").fetchone()[0]
        assert spark_rows == duck_rows, name
