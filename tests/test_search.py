"""Search operators against brute force on small fixtures."""

import math

import numpy as np
import pytest

from pagetrail.operators import embed, search


def test_bm25_matches_brute_force(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog"), (3, "Cät and dog and cat"), (4, "nothing here"), (5, "cat")]
    queries = [(0, "cat"), (1, "dog cat"), (2, "zebra"), (3, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(queries, "qid long, text string")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in search.bm25(d, q, id_col="doc_id", text_cols=["text"], k=10).collect()}

    toks = {i: [t for t in t_.lower().replace("ä", "a").split() if t] for i, t_ in docs}
    n = len(docs)
    avgdl = sum(len(v) for v in toks.values()) / n
    want = {}
    for qid, text in queries:
        terms = set(text.lower().split())
        if not terms:
            continue
        for i, tk in toks.items():
            if not terms <= set(tk):
                continue
            s = 0.0
            for t in terms:
                df = sum(1 for v in toks.values() if t in v)
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                tf = tk.count(t)
                s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tk) / avgdl))
            want[(qid, i)] = round(s, 6)
    assert got == pytest.approx(want)


def test_bm25_of_copies_and_repeated_queries(spark):
    """Many copies with equal scores: the smallest ids win, for every query of the same terms."""
    texts = ["the cat sat", "the cat sat on the mat", "cat sat the", "a dog", ""]
    docs = [(100 - i, texts[i % 5]) for i in range(60)]
    queries = [(1, "cat"), (2, "CAT cat!"), (3, "the sat"), (4, "dog a dog"), (5, "sat the")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(queries, "qid long, text string")
    hits = {}
    for r in sorted(search.bm25(d, q, id_col="doc_id", text_cols=["text"], k=15).collect(), key=lambda r: (r.qid, r["rank"])):
        hits.setdefault(r.qid, []).append((r.doc_id, r.score))
    short = sorted(i for i, t in docs if t in (texts[0], texts[2]))
    assert [i for i, _ in hits[1]] == short[:15] and hits[1] == hits[2] and hits[3] == hits[5]
    assert [i for i, _ in hits[4]] == sorted(i for i, t in docs if t == "a dog")
    one = search.bm25(d, q, id_col="doc_id", text_cols=["text"], k=1).collect()
    assert {(r.qid, r.doc_id) for r in one if r.qid < 3} == {(1, short[0]), (2, short[0])}


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(200, 8)).astype(np.float32)
    qs = rng.normal(size=(3, 8))
    v = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(200)], "page_id long, embedding array<float>")
    q = spark.createDataFrame([(j, qs[j].tolist()) for j in range(3)], "qid long, vector array<double>")
    got = search.knn(v.repartition(5), q, k=4).collect()
    for j in range(3):
        d = np.sqrt(((vecs.astype(np.float64) - qs[j]) ** 2).sum(axis=1))
        want = list(np.argsort(d, kind="stable")[:4])
        mine = [r["doc_id"] for r in sorted((r for r in got if r["qid"] == j), key=lambda r: r["rank"])]
        assert mine == want


def test_knn_dimension_mismatch_is_an_error(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "page_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, vector array<double>")
    with pytest.raises(Exception):
        search.knn(v, q, k=1).collect()


def test_hybrid_rrf(spark):
    kw = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, doc_id long, rank int")
    vv = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid long, doc_id long, rank int")
    out = {r["doc_id"]: r["score"] for r in search.hybrid(kw, vv, k=3).collect()}
    assert out[2] == pytest.approx(round(1 / 62 + 1 / 61, 6))
    assert out[1] == pytest.approx(round(1 / 61, 6))


def test_candidate_texts_dedupe_keeps_first(spark):
    pages = spark.createDataFrame([(1, " T ", "https://ex.com/a?q=1"), (2, "T", "https://ex.com/a")],
                                  "page_id long, title string, url string")
    rows = {}
    for r in embed.candidates(pages).collect():
        rows.setdefault(r["page_id"], []).append((r["attempt"], r["text"]))
    assert rows[1][0] == (1, "title: T\nurl: https://ex.com/a?q=1")
    assert rows[1][1] == (2, "title: T\nurl: https://ex.com/a")
    assert [a for a, _ in rows[2]] == [1, 2]
    assert rows[2][1] == (2, "url: https://ex.com/a")


def test_encoder_failures_become_rows(spark):
    pages = spark.createDataFrame([(1, "a", "https://a.test/"), (2, "b", "https://b.test/")], "page_id long, title string, url string")

    def always_fails(model, texts):
        raise RuntimeError("down")

    def wrong_dims(model, texts):
        return [[1.0, 2.0] for _ in texts]

    for enc in (always_fails, wrong_dims):
        out = embed.encode_pages(pages, model_name="m", dims=4, encoder=enc, batch_size=2).collect()
        assert len(out) == 2 and all(r["embedding"] is None and r["error"] for r in out)
    one = pages.coalesce(1)  # both pages in one task, so in one batch
    out = embed.encode_pages(one, model_name="m", dims=4, encoder=always_fails, batch_size=2, fallback=False).collect()
    assert all(r["strategy"] == "batch" and r["embedding"] is None for r in out)
    assert sum(1 for r in out if r["error"]) == 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_and_share_at_the_settings_of_the_query(spark, sf):
    from pagetrail.operators import ivf
    from pagetrail.plans import catalog
    from pagetrail.sources import tables as tb

    d = f"/root/testdata/{sf}"
    exact = catalog.QUERIES["search_knn"](spark, d)
    approx = catalog.QUERIES["search_ann"](spark, d)
    recall = [r["recall"] for r in search.recall_at_k(approx, exact).collect()]
    v = tb.vectors(spark, d)
    q = catalog._vector_queries(spark, d)
    assert len(recall) == q.count() and sum(recall) / len(recall) >= 0.9
    index = ivf.build(v)
    assert index.lists.count() == v.count() == index.total
    cost = ivf.candidates(index, q, 0.2).collect()
    assert len(cost) == q.count() and sum(r["compared"] for r in cost) <= 0.2 * v.count() * q.count()


def test_ann_splits_a_cell_with_most_vectors(spark, monkeypatch):
    from pagetrail.operators import ivf

    monkeypatch.setattr(ivf, "PIECE", 7)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, [float(i), 1.0, 2.0, -1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "page_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [7.0, 1.0, 2.0, -1.0])], "qid long, vector array<double>")
    index = ivf.build(v, cells=5)
    groups = index.lists.groupBy("cell", "piece").count().collect()
    assert sum(r["count"] for r in groups) == 100 and max(r["count"] for r in groups) < 25
    hits = {(r.qid, r["rank"]): r.doc_id for r in search.ann(v, q, k=3, share=0.7, cells=5).collect()}
    assert [hits[0, i] for i in (1, 2, 3)] == [0, 1, 2] and hits[1, 1] == 107
    assert sorted(map(tuple, search.ann(v, q, k=4, share=1.0, cells=5).collect())) == sorted(map(tuple, search.knn(v, q, k=4).collect()))
    assert search.ann(v.limit(0), q).count() == 0 and search.ann(v, q.limit(0)).count() == 0


def test_nearest_of_blocks_with_ties_and_cosine():
    from pagetrail.operators import nearest

    g = np.random.default_rng(8)
    x = np.concatenate([g.integers(-2, 3, (300, 3)).astype(float), np.zeros((30, 3)), np.full((200, 3), 2.0)])
    ids = g.permutation(len(x)).astype(np.int64)
    q = np.concatenate([g.integers(-2, 3, (20, 3)).astype(float), g.normal(size=(5, 3))])
    for metric in ("l2", "cosine"):
        for chunk in (7, 4096):
            nearest.CHUNK = chunk
            best = nearest.Best(q, 6, metric, 9)
            best.add(x, ids)
            for j in range(len(q)):
                d = nearest.exact_distances(x, np.repeat(q[j : j + 1], len(x), 0), metric, 9)
                order = np.lexsort((ids, d))[:6]
                mine = best.row == j
                assert best.id[mine].tolist() == ids[order].tolist()
                assert np.array_equal(best.distance[mine], d[order], equal_nan=True)
    nearest.CHUNK = 4096


def test_knn_collects_nothing_and_takes_many_queries(spark):
    g = np.random.default_rng(9)
    vecs = g.normal(size=(3000, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "page_id long, embedding array<float>")
    hits = search.knn(v, v.selectExpr("page_id as qid", "embedding as vector"), k=1)
    assert "Cartesian" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.filter("qid <> doc_id or distance <> 0").count() == 0 and hits.count() == 3000


def test_exact_url_title_and_host(spark):
    pages = spark.createDataFrame(
        [(1, "https://ex.com/a", "ex.com", "Alpha"), (2, "https://ex.com/b", "ex.com", "Beta"), (3, "https://o.test/", "o.test", "(untitled)")],
        "page_id long, url string, host string, title string",
    )
    q = spark.createDataFrame([("HTTPS://EX.com:443/a#x",), ("https://none.test/",)], "url string")
    assert [r["page_id"] for r in search.exact(q, pages).collect()] == [1]
    t = spark.createDataFrame([(" Beta ",), ("",)], "title string")
    assert sorted(r["page_id"] for r in search.exact_title(t, pages).collect()) == [2, 3]
    h = spark.createDataFrame([("EX.COM.",)], "host string")
    assert sorted(r["page_id"] for r in search.exact_host(h, pages).collect()) == [1, 2]


def test_knn_in_query_blocks(spark, monkeypatch):
    from pagetrail.operators import search

    v = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(100)], "page_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "qid long, vector array<double>")
    whole = sorted(map(tuple, search.knn(v, q, k=3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, search.knn(v, q, k=3).collect())) == whole and len(whole) == 60


def test_bm25_scans_the_text_once(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plans, stored = [], search.stored

    def recording(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(search, "stored", recording)
    queries = spark.createDataFrame([(0, "the of")], "qid long, text string")
    plans.append(search.bm25(docs, queries, id_col="doc_id", text_cols=["text"])._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("testdata/sf0.001/documents.parquet") for p in plans) == 1


def test_bm25_counts_terms_in_parts_of_bounded_documents(spark, monkeypatch):
    """More documents make more parts to count in, not larger ones; rows that share an id are counted together."""
    import re

    docs = spark.createDataFrame([(i % 55, f"the cat number{i} sat on mat{i % 3}") for i in range(60)], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "cat"), (2, "the mat1")], "qid long, text string")
    whole = sorted(map(tuple, search.bm25(docs, queries, id_col="doc_id", text_cols=["text"], k=60).collect()))
    plans, stored = {}, search.stored

    def recording(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(search, "stored", recording)
    monkeypatch.setattr(search, "DOC_PART", 2)
    assert sorted(map(tuple, search.bm25(docs, queries, id_col="doc_id", text_cols=["text"], k=60).collect())) == whole
    assert re.search(r"hashpartitioning\(doc_id#\d+L, 30\)", plans["term_counts"])
    assert sum(q == 1 for q, *_ in whole) == 55
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)  # too many query terms to send: counts are summed before they meet them
    assert sorted(map(tuple, search.bm25(docs, queries, id_col="doc_id", text_cols=["text"], k=60).collect())) == whole
    assert plans["term_counts"].index("Join") < plans["term_counts"].index("Aggregate")


def _brute_bm25(docs, queries, k, require_all):
    toks = {i: t.split() for i, t in docs}
    avgdl = sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in t for t in toks.values()) for w in {w for t in toks.values() for w in t}}
    hits = set()
    for qid, text in queries:
        terms, scores = set(text.split()), []
        for i, t in toks.items():
            held = terms & set(t)
            if held and (held == terms or not require_all):
                part = lambda w: math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
                scores.append((-round(sum(map(part, held)), 9), i))
        hits |= {(qid, i, rank, round(-s, 6)) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return hits


@pytest.mark.parametrize("broadcast, sieve", [(100_000, 32 << 20), (0, 32 << 20), (0, 1), (100_000, 1)])
def test_bm25_through_sieves_matches_brute_force(spark, monkeypatch, broadcast, sieve):
    """Also where a sieve has a single block, which lets nearly all rows pass."""
    g = np.random.default_rng(5)
    docs = [(i, " ".join(f"w{int(x)}" for x in g.zipf(1.5, g.integers(1, 60)) if x < 400) or "w1") for i in range(300)]
    queries = [(1000 + i, t) for i, t in docs[::7]] + [(1, "w1"), (2, "w1 w2 w3"), (3, "w1 nowhere"), (4, "w2 w2 w5")]
    monkeypatch.setattr(search, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(search, "SIEVE_BYTES", sieve)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = spark.createDataFrame(queries, "qid long, text string")
    for require_all in (True, False):
        got = {(r.qid, r.doc_id, r["rank"]): r.score for r in search.bm25(d, q, id_col="doc_id", text_cols=["text"], k=9, require_all=require_all).collect()}
        assert got == pytest.approx({x[:3]: x[3] for x in _brute_bm25(docs, queries, 9, require_all)}, abs=2e-6)


def test_bm25_neither_shuffles_all_counts_nor_leaves_them(spark, monkeypatch):
    """Whole counts are not dealt by term; documents without the second rarest term of a query are no candidates; what is not read again is deleted."""
    import os

    docs = [(i, f"the cat sat rare{i % 2} only{i}") for i in range(60)] + [(i, "the cat sat rare0 uncommon") for i in range(60, 64)]
    queries = [(1, "the cat sat rare0 uncommon"), (2, "cat rare1 only3")]
    plans, tables, rows, stored = {}, {}, {}, search.stored

    def recording(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        tables[name] = stored(df, name)
        rows[name] = tables[name].count()
        return tables[name]

    monkeypatch.setattr(search, "stored", recording)
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    hits = search.bm25(d, spark.createDataFrame(queries, "qid long, text string"), id_col="doc_id", text_cols=["text"], k=10)
    assert sorted((r.qid, r.doc_id) for r in hits.collect()) == [(1, 60), (1, 61), (1, 62), (1, 63), (2, 3)]
    assert "hashpartitioning(term" not in plans["term_counts"]
    assert rows["candidates"] == 2  # one of the four copies, and document 3
    left = {name for name, t in tables.items() if os.path.exists(t._stored_at.removeprefix("file:"))}
    assert left == {"queries", "documents", "best_documents"}


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from pagetrail.sources.scratch import CLEANUP, stored

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    conf, before = spark.conf.get(CLEANUP, "false"), shuffles()
    table = stored(spark.range(1000).repartition(7, "id"), "spread")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffles() - before and spark.conf.get(CLEANUP, "false") == conf
    assert table.count() == 1000


def test_knn_deals_vectors_and_queries_so_that_few_rows_are_shuffled(spark, monkeypatch):
    """Many tasks do not send every query to each of them; as many pairs of parts and blocks as tasks, within the sizes of both."""
    for n, m, tasks in [(600_000, 30_000, 600), (51_282, 2_564, 50), (3_000, 3_000, 3), (10, 1, 8), (10**9, 5 * 10**7, 4_000), (100, 10**6, 4)]:
        parts, blocks = search._grid(n, m, tasks)
        old_parts, old_blocks = max(-(-n // search.VECTOR_PART), tasks), -(-m // search.QUERY_BLOCK)
        assert parts * blocks >= old_parts * old_blocks and parts >= -(-n // search.VECTOR_PART) and m >= blocks >= old_blocks
        assert n * blocks + m * parts <= n * old_blocks + m * old_parts
    parts, blocks = search._grid(600_000, 30_000, 600)
    assert 600_000 * blocks + 30_000 * parts < 0.4 * (600_000 + 30_000 * 600)
    g = np.random.default_rng(4)
    vecs = g.normal(size=(400, 3)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vecs)], "page_id long, embedding array<float>")
    q = v.filter("page_id % 20 = 0").selectExpr("page_id as qid", "embedding as vector")
    whole = sorted(map(tuple, search.knn(v, q, k=5).collect()))
    grids, grid = [], search._grid
    monkeypatch.setattr(search, "_grid", lambda *a: grids.append(grid(*a[:2], 400)) or grids[-1])
    assert sorted(map(tuple, search.knn(v, q, k=5).collect())) == whole and len(whole) == 100
    assert grids[0][1] > 1
