"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    decontaminate,
    html_extract,
    lang_id,
    license_scan,
    minhash_join,
    quality,
    suffix_dedup,
    url_filter,
    vector_codes,
    warc,
    whitening,
)
from .shared import table


def tokenizer_path() -> str:
    """The public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predictions(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scans(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), threshold=100)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"),
    )
    rows = chat.canonical(table(spark, sf_dir, "conversations")).unionByName(chat.canonical(extra))
    return chat.digests(rows)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# sites whose pages the query's list of URLs names
JUNK_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules, and as listed URLs those of the junk sites' pages: a list that grows with the table."""
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.host_and_path(F.col("url"))
    junk = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, JUNK_SITES)))
    listed = pages.select(host.alias("host"), path.alias("path")).filter(junk)
    return url_filter.judged(pages, url_filter.rule_rows(spark, URL_RULES), listed)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_language_id,
        op3_license_scan,
        op4_suffix_dedup,
        op5_bpe,
        op6_quality,
        op7_minhash_join,
        op8_warc,
        op9_decontamination,
        op10_chat_format,
        op11_embedding_whitening,
        op12_vector_codes,
        op13_url_filter,
    )
}

_ESCAPED = "replace({0}, '␛', '␛E')"
for _c in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '␛L{_c[1:]}')"
for _c in ("[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '␛B{_c[1:]}')"

_ROUND = """
m{r} AS (SELECT part, entry, pos, CAST(floor(sum(v)::DECIMAL(38,0) / count(*)) AS BIGINT) AS v FROM a{r} JOIN x USING (r, part) GROUP BY part, entry, pos),
c{n} AS (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos),
"""
_ASSIGN = """
a{r} AS (SELECT r, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL) GROUP BY r, part)"""

ORACLE_SQL = {
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r WHERE k > 1),
t AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
runs AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM t GROUP BY doc_id, run),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM runs),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS front, max(hi) AS tail, sum(hi - lo) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE front || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_minhash_join": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)
  UNION ALL SELECT doc_id, ws[1] FROM w WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(low.b, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id""",
    "op8_warc": """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM s)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM documents)),
b AS (SELECT item_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM (
  SELECT item_id, ws, len(ws) AS n FROM (
    SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM benchmark) WHERE len(ws) >= 6)),
m AS (SELECT doc_id, item_id, n, i - j AS s, j FROM d JOIN b USING (w) WHERE w <> ''),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, s ORDER BY j RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS c,
  count(*) OVER (PARTITION BY doc_id, item_id, s) AS total FROM m),
g AS (SELECT doc_id, item_id, s, max(n) AS n, max(total) AS total FROM k WHERE 100 * c >= 80 * least(n, 20) GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, max(total)::INTEGER AS n_matched, max(n)::INTEGER AS n_words, max(total) / max(n) AS overlap FROM g GROUP BY doc_id, item_id""",
    "op10_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|turn|>' || {_ESCAPED.format('role')} || chr(10) || {_ESCAPED.format('text')} || '<|end|>' || chr(10))
      + CASE WHEN role = 'assistant' THEN length('<|loss|><|/loss|>') ELSE 0 END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars
FROM g""",
    "op12_vector_codes": f"""
WITH k AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT r, (i - 1) * 16 // len(embedding) AS part, (i - 1) % (len(embedding) // 16) AS pos, floor(256 * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
c0 AS (SELECT part, r - 1 AS entry, pos, v FROM x WHERE r <= 64),{_ASSIGN.format(r=0)},{_ROUND.format(r=0, n=1)}{_ASSIGN.format(r=1)[1:]},{_ROUND.format(r=1, n=2)}{_ASSIGN.format(r=2)[1:]},
o AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 JOIN k USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c2) AS codebooks_sha256
FROM o""",
    "op13_url_filter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT DISTINCT host, path, true AS junk FROM p WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])),
w AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, w.host, w.path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NULL AND junk THEN 'block' ELSE 'allow' END AS verdict
FROM w LEFT JOIN j ON j.host = w.host AND j.path = w.path""",
}
