"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join; DataFrame functions only.

A canonical URL is its host (between the first ``://`` and the next ``/``, ``?``,
``#`` or the end, A-Z lower-cased) and its path (from there up to ``?``, ``#`` or
the end). Two lists take part:

* ``rules`` (host, path, verdict) fit their host and all its subdomains where
  the path starts with the rule's; the longest rule that fits wins;
* ``listed`` (host, path) are single URLs, blocked unless a rule decides.

All entries become keys. A key sets one bit in each of the four 64-bit words of
one block of the filter; the number of blocks follows the counted keys. Every URL
asks for its own key and for one key per shape of the rules (number of host
labels, length of path), so the work for a URL does not grow with the lists, and long hosts and
paths are cut once per shape only. What the filter passes is joined to the
entries themselves by hash key and by the strings, which removes false
positives; nothing is lost, since every listed key has its bits set.

The filter is broadcast while its counted size is within ``BROADCAST_BYTES``,
beyond that it is joined by block, which spreads evenly. The stored entries are
joined as their size on disk demands. Only URLs with possible hits are shuffled before the
verdicts are joined back; the best entry of a URL is found with a partial aggregate, so repeated
URLs of one hot page meet as one row per task.

Rows: a null URL, or one without ``://``, has an empty host and path, fits
nothing and is allowed; repeated rows and ids get a row each; entries with an
empty host fit nothing; repeated entries count once (block before allow among equal
rules); empty lists allow everything. Columns besides ``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

KEYS_PER_BLOCK = 16
WORDS = 4
BLOCK_BYTES = 8 * (WORDS + 2)
BROADCAST_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def rule_rows(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(host, path, verdict) from pairs such as ``("block", "example.com/de/")``; the host ends at the first slash."""
    parts = [(verdict, *(entry.split("/", 1) if "/" in entry else (entry, None))) for verdict, entry in rules]
    rows = [F.struct(F.lit(h).alias("host"), F.lit("" if p is None else "/" + p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in parts]
    if not rows:
        return spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "verdict")])
    return spark.range(1).select(F.inline(F.array(*rows)))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct entries: exact (a single URL), host, path, verdict."""
    mine = rules.select(F.lit(False).alias("exact"), "host", "path", "verdict")
    urls = listed.select(F.lit(True).alias("exact"), "host", "path", F.lit("block").alias("verdict"))
    all_ = mine.unionByName(urls).filter("host <> '' and path is not null")
    return all_.groupBy("exact", "host", "path").agg(F.max("verdict").alias("verdict"))


def _key(exact: Column, host: Column, path: Column) -> Column:
    return F.xxhash64(exact, host, path)


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the key's block, from six bits of a second hash each."""
    second = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0...): the blocked Bloom filter of a column ``key``; blocks without keys have no row."""
    words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("key")))]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words)


def possible(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows whose ``key`` may be listed: all listed ones, and a few others."""
    small = F.broadcast if blocks * BLOCK_BYTES <= BROADCAST_BYTES else (lambda df: df)
    hit = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(_bits(F.col("key")))])
    return rows.withColumn("block", _block(F.col("key"), blocks)).join(small(filter_), "block").filter(hit).select(*rows.columns)


def blocks_for(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_BLOCK))


def asked(urls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(host, path, exact, key_host, key_path, key): everything that may be listed for each URL of ``urls`` (host, path)."""
    own = F.struct(F.lit(True).alias("exact"), F.col("host").alias("key_host"), F.col("path").alias("key_path"))
    cuts = [
        F.struct(F.lit(False).alias("exact"), F.substring_index("host", ".", -labels).alias("key_host"), F.substring("path", 1, length).alias("key_path"))
        for labels, length in shapes
    ]
    rows = urls.filter("host <> ''").select("host", "path", F.inline(F.array(own, *cuts)))
    return rows.withColumn("key", _key(F.col("exact"), F.col("key_host"), F.col("key_path")))


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null), verdict (allow or block)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    entries = stored(_entries(rules, listed).withColumn("key", _key(F.col("exact"), F.col("host"), F.col("path"))), "listed_urls")
    blocks = blocks_for(entries.count())
    filter_ = stored(bloom(entries, blocks), "bloom_blocks")
    shapes = [tuple(r) for r in entries.filter(~F.col("exact")).select(_labels(F.col("host")), F.length("path")).distinct().collect()]  # as many as the rules have
    hits = possible(asked(rows.select("host", "path"), sorted(shapes)), filter_, blocks)
    known = entries.select("key", "exact", F.col("host").alias("key_host"), F.col("path").alias("key_path"), "verdict")
    # a rule before a listed URL, then the longest; of equally long rules that with the longer host
    rank = F.struct(
        (~F.col("exact")).alias("is_rule"),
        (F.length("key_host") + F.length("key_path")).alias("length"),
        F.length("key_host").alias("host_length"),
        F.when(~F.col("exact"), F.concat("key_host", "key_path")).alias("rule"),
        "verdict",
    )
    best = hits.join(known, ["key", "exact", "key_host", "key_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
