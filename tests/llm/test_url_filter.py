"""URL filters: rules and listed URLs against plain Python, and the Bloom filter itself."""

import random

from pyspark.sql import functions as F

from pagetrail.llm import url_filter
from pagetrail.llm.queries import URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:cut]


def brute(url, rules, listed):
    host, path = split(url)
    fits = []
    for verdict, rule in rules:
        h, p = (rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) if "/" in rule else (rule, "")
        if host and h and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), h + p, verdict))
    if fits:
        best = max(fits)
        return host, path, best[2], best[3]
    return host, path, None, "block" if host and (host, path) in listed else "allow"


def check(spark, urls, rules, listed, repeat=3):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule", "1 as verdict", "'k' as key").repartition(repeat)
    table = spark.createDataFrame(listed, "host string, path string")
    out = url_filter.judged(pages, url_filter.rule_rows(spark, rules), table)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules, set(listed)), urls[r.page_id]


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.net", "http://example.net/", "HTTP://WWW.Example.NET/en/x?q#f", "https://example.net?/en/", "https://anexample.net/en/",
    "https://net/", "https://net/en", "https://x.org/fr/", "https://org/fr/1", "https://x.org/FR/", "https://x.org/fr", "https://borg/fr/", "a://b://c/d", "https://example.com/de/", "https://a.b.example.com/de/z/../",
    "https://example.com:80/de/", "https://u@example.com/de/", "https://ÉX.net/é", "https://example.com./de/", "https://.net/", "https://..net/x", "x://y.net/a\nb?c", "https://example.com/de/#://example.net/",
    "https://" + "a." * 50000 + "net/" + "p" * 100000, "z" * 300000, "https://" + "q" * 100000 + ".org/fr/" + "/" * 100000,
]


def test_rules_of_the_query(spark):
    check(spark, URLS + URLS[5:9] * 3, URL_RULES, [])


def test_listed_urls_and_general_rules(spark):
    g = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "x.com", "a.org"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é/"]
    urls = [f"http://{g.choice(hosts)}{g.choice(paths)}{g.choice(['', '?q', '#f'])}" for _ in range(300)] + ["http://A.com/a"] * 200
    rules = [("block", "a.com/a"), ("allow", "b.a.com/"), ("block", "com/a/b"), ("allow", "a.com/a/b"), ("block", "x.com"), ("block", "org/é")]
    listed = [("a.com", "/ab"), ("a.com", "/ab"), ("a.org", ""), ("b.a.com", "/a/"), ("com", "/"), ("", ""), ("", "/")]
    check(spark, urls, rules, listed, 7)
    check(spark, urls, [], listed)
    check(spark, urls, rules, [])
    check(spark, urls[:20], [], [])
    check(spark, [], rules, listed)


def test_many_listed_urls_pass_the_filter_and_few_others(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("key"))
    blocks = url_filter.blocks_for(200_000)
    made = url_filter.bloom(keys, blocks)
    assert made.count() <= blocks
    assert url_filter.possible(keys, made, blocks).count() == 200_000
    others = spark.range(1_000_000, 1_200_000).select(F.xxhash64("id").alias("key"))
    assert url_filter.possible(others, made, blocks).count() < 0.01 * 200_000


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "blocks_for", lambda keys: 1)  # a full filter passes everything
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)  # and the shuffled form is used
    listed = [(f"h{i}.com", f"/{j}") for i in range(20) for j in range(20)]
    check(spark, [f"http://h{i}.com/{j}" for i in range(25) for j in range(25)], URL_RULES, listed)


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.judged(pages, url_filter.rule_rows(spark, URL_RULES), pages.selectExpr("'a' as host", "'/' as path"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
