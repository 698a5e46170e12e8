"""Keyword index: results against plain BM25 over all pages, replacement per page, pruning of blocks."""

import math
import random
import re
import tempfile

import pytest

from pagetrail.functions.text import ACCENTED, FOLDED
from pagetrail.operators import keyword_index
from pagetrail.sources.lake import Lake

FOLD = str.maketrans(ACCENTED, FOLDED)
SCHEMA = "page_id long, title string, url string, bookmark_text string"


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower().translate(FOLD)) if w]


def brute(docs, queries, k, weights, require_all=True):
    tok = {p: [words(f) for f in fields] for p, *fields in docs}
    length = {p: sum(w * len(t) for w, t in zip(weights, fs)) for p, fs in tok.items()}
    average = sum(length.values()) / len(length)
    tf = {p: {x: sum(w * t.count(x) for w, t in zip(weights, fs)) for x in {x for t in fs for x in t}} for p, fs in tok.items()}
    df = {}
    for m in tf.values():
        for x in m:
            df[x] = df.get(x, 0) + 1
    out = []
    for q, text in queries:
        terms, scored = set(words(text)), []
        for p, m in tf.items():
            hit = [x for x in terms if x in m]
            if not hit or (require_all and len(hit) < len(terms)):
                continue
            s = sum(math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * m[x] * 2.2 / (m[x] + 1.2 * (0.25 + 0.75 * length[p] / average)) for x in hit)
            scored.append((-round(s, 9), p, round(s, 6)))
        out += [(q, p, i + 1, s) for i, (_, p, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def corpus(n, seed):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["très", "Über"]
    pick = lambda m: " ".join(vocabulary[min(int(g.expovariate(0.12)), 61)] for _ in range(m))
    return [(g.randrange(10**15), pick(g.randint(0, 9)), f"https://{pick(1)}.test/{pick(2).replace(' ', '/')}", pick(g.choice([0, 0, 3, 40]))) for _ in range(n)]


QUERIES = [(1, "w0"), (2, "w1 w2"), (3, "TRES"), (4, "w30 w3"), (5, ""), (6, "unknown w1"), (7, "w0 w1 w2 w3"), (8, "https test w5"), (9, None)]


def found(index, queries, **kw):
    hits, report = keyword_index.search(index, queries, **kw)
    return sorted((r.qid, r.page_id, r["rank"], r.score) for r in hits.collect()), {r.qid: (r.blocks_read, r.blocks) for r in report.collect()}


@pytest.fixture()
def base():
    return "file:" + tempfile.mkdtemp(prefix="pagetrail-kw-")


def test_equals_plain_bm25_and_reads_few_blocks(spark, base):
    docs = corpus(4000, 1)
    index = keyword_index.update(spark, base, spark.createDataFrame(docs, SCHEMA), shards=4)
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    got, report = found(index, queries, k=5)
    assert got == brute(docs, QUERIES, 5, (1, 1, 1))
    assert all(read <= blocks for read, blocks in report.values())
    assert report[1][0] < 0.5 * report[1][1] and report[8][0] < 0.5 * report[8][1]
    got, _ = found(index, queries, k=7, weights=(3.0, 0.5, 1.0), require_all=False)
    assert got == brute(docs, QUERIES, 7, (3.0, 0.5, 1.0), False)


def test_a_block_left_out_by_a_wrong_bound_would_show(spark, base, monkeypatch):
    """Without the blocks that reach the threshold results differ: the second pass is needed."""
    docs = corpus(600, 2)
    index = keyword_index.update(spark, base, spark.createDataFrame(docs, SCHEMA))
    queries = spark.createDataFrame(QUERIES[:4], "qid long, text string")
    monkeypatch.setattr(keyword_index, "FIRST", 1)
    assert found(index, queries, k=8)[0] == brute(docs, QUERIES[:4], 8, (1, 1, 1))
    monkeypatch.setattr(keyword_index, "SLACK", -1e9)  # no block reaches the threshold any more
    monkeypatch.setattr(keyword_index, "FIRST", 0.01)
    assert found(index, queries, k=8)[0] != brute(docs, QUERIES[:4], 8, (1, 1, 1))


def test_pages_are_replaced_and_only_their_shards_rewritten(spark, base):
    docs = corpus(200, 3)
    index = keyword_index.update(spark, base, spark.createDataFrame(docs, SCHEMA))
    changed = [(docs[0][0], "brand new words", "https://x.test/", "w0"), (docs[1][0], None, None, None), (10**16 + 3, "w0 added", "u", "")]
    gone = [docs[5][0], 424242]
    before = index.manifest()["tables"]
    index = keyword_index.update(spark, base, spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([(g,) for g in gone], "page_id long"))
    after = index.manifest()["tables"]
    shards = {str(p % 16) for p in [c[0] for c in changed] + gone}
    for table in ("postings", "lengths", "blocks", "totals"):
        assert {s for s in before[table]["parts"] if before[table]["parts"][s] != after[table]["parts"].get(s)} <= shards
    now = [d for d in docs if d[0] not in gone and d[0] not in {c[0] for c in changed}] + changed
    queries = spark.createDataFrame(QUERIES + [(20, "brand words")], "qid long, text string")
    assert found(index, queries)[0] == brute(now, QUERIES + [(20, "brand words")], 10, (1, 1, 1))
    assert found(Lake(spark, base), queries)[0] == found(index, queries)[0]


def test_empty(spark, base):
    none = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame(QUERIES, "qid long, text string")
    index = keyword_index.update(spark, base, none)
    assert found(index, queries) == ([], {})
    index = keyword_index.update(spark, base, spark.createDataFrame([(1, "a", "b", ""), (1, "a", "b", "")], SCHEMA))
    assert found(index, spark.createDataFrame([(1, "a")], "qid long, text string"))[0][0][:3] == (1, 1, 1)
    index = keyword_index.update(spark, base, none, spark.createDataFrame([(1,)], "page_id long"))
    assert found(index, queries) == ([], {})
    assert found(index, queries.limit(0)) == ([], {})
