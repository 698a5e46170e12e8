"""DuckDB SQL for the registered queries (the correctness oracle).

Written independently of the Spark code: its own regular expressions for
URL parts, DuckDB's GLOB for rule patterns, window functions for top-k and
recursive CTEs for folders. Only the configuration values are shared.
"""

from __future__ import annotations

from .catalog import (
    ACTIVE_MODEL,
    EXPORT_PARTS,
    FIELD_WEIGHTS,
    HYBRID_DEPTH,
    INGEST_DAYS,
    LIMIT_PER_PROFILE,
    MAX_ITEMS,
    RECENT_DAYS,
    RULES,
    TEXT_QUERIES,
    TOP_K,
)
from ..functions.text import ACCENTED, FOLDED, UNTITLED

DAY = 86_400_000_000
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(expr: str) -> str:
    stripped = f"regexp_replace(coalesce({expr}, ''), '^{WS}+|{WS}+$', '', 'g')"
    return f"CASE WHEN {stripped} = '' THEN '{UNTITLED}' ELSE {stripped} END"


def _hid(expr: str) -> str:
    return f"CAST('0x' || substr(sha256({expr}), 1, 15) AS BIGINT)"


BASE = rf"""
n AS (SELECT count(*) AS n FROM pages),
places AS (
  SELECT p.page_id*4+v.v AS place_id,
    CASE v.v WHEN 0 THEN p.url WHEN 1 THEN concat(p.url,'#v1')
      WHEN 2 THEN concat(upper(regexp_extract(p.url,'^(https?://[^/]+)',1)), regexp_replace(p.url,'^https?://[^/]+',''))
      ELSE concat(regexp_extract(p.url,'^(https?://[^/]+)',1), CASE WHEN p.url LIKE 'https%' THEN ':443' ELSE ':80' END,
                  regexp_replace(p.url,'^https?://[^/]+','')) END AS url,
    CASE v.v WHEN 3 THEN '' ELSE regexp_extract(p.html,'<title>([^<]*)</title>',1) END AS title
  FROM pages p CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v),
visits AS (
  SELECT e.event_id AS visit_id, (e.event_id*7) % (n.n*4) AS place_id, epoch_us(e.ts) AS visit_date,
    CASE WHEN e.user_id % 3 = 0 THEN 'firefox' ELSE 'zen' END AS browser,
    concat('p', CAST(e.user_id % 5 AS VARCHAR)) AS profile
  FROM events e CROSS JOIN n),
vis AS (
  SELECT *, CASE browser WHEN 'zen' THEN 0 ELSE 1 END AS browser_rank,
    '/profiles/' || browser || '/' || profile || '/places.sqlite' AS store_path
  FROM visits),
as_of AS (SELECT max(visit_date) AS t FROM visits),
urlparts AS (
  SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS netloc,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM (SELECT DISTINCT url FROM places UNION SELECT DISTINCT url FROM pages)),
urlhost AS (
  SELECT *, regexp_extract(netloc, '^(.*@)', 1) AS userinfo,
    lower(regexp_extract(regexp_extract(netloc, '([^@]*)$', 1), '^([^:]*)', 1)) AS host,
    regexp_extract(regexp_extract(netloc, '([^@]*)$', 1), '^[^:]*:(.*)$', 1) AS port
  FROM urlparts),
canon AS (
  SELECT url, host,
    CASE WHEN sch = '' OR (sch IN ('http','https') AND host = '') THEN NULL
      WHEN port <> '' AND NOT regexp_matches(port, '^[0-9]{{1,5}}$') THEN NULL
      WHEN port <> '' AND CAST(port AS BIGINT) > 65535 THEN NULL
      ELSE sch || '://' || userinfo || host ||
        CASE WHEN port = '' OR (sch = 'http' AND CAST(port AS BIGINT) = 80) OR (sch = 'https' AND CAST(port AS BIGINT) = 443)
             THEN '' ELSE ':' || CAST(CAST(port AS BIGINT) AS VARCHAR) END ||
        CASE WHEN path = '' THEN '/' ELSE path END ||
        CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS canonical_url
  FROM urlhost),
snap AS (
  SELECT v.browser, v.profile, v.place_id AS id, p.url, p.title, max(v.visit_date) AS last_visit_date
  FROM visits v JOIN places p USING (place_id)
  GROUP BY v.browser, v.profile, v.place_id, p.url, p.title),
entries AS (
  SELECT s.browser, s.profile, {_clean('s.title')} AS title, s.url, c.canonical_url, s.last_visit_date, s.id
  FROM snap s JOIN canon c USING (url)
  WHERE s.url IS NOT NULL AND trim(s.url) <> '' AND c.canonical_url IS NOT NULL),
deduped AS (
  SELECT browser, profile, title, url, canonical_url, last_visit_date FROM (
    SELECT *, row_number() OVER (PARTITION BY canonical_url
      ORDER BY last_visit_date DESC, browser, profile, url, title) AS rn FROM entries) WHERE rn = 1),
rows_all AS (
  SELECT v.browser, v.profile, v.browser_rank, v.store_path, v.visit_id AS source_visit_id, p.url AS raw_url,
    coalesce(p.title, '') AS raw_title, coalesce(v.visit_date, 0) AS visited_at_us
  FROM vis v JOIN places p USING (place_id)
  WHERE p.url IS NOT NULL AND trim(p.url) <> ''),
annot AS (
  SELECT r.*, c.canonical_url, c.host, {_clean('r.raw_title')} AS title,
    {_hid("r.browser || ':' || r.store_path")} AS source_profile_id
  FROM rows_all r JOIN canon c ON c.url = r.raw_url),
ptarget AS (
  SELECT u AS target,
    rtrim(lower(regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '.') AS phost,
    CASE WHEN regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS ppath
  FROM (SELECT DISTINCT canonical_url AS u FROM canon WHERE canonical_url IS NOT NULL)),
bm AS (
  SELECT d.doc_id AS bookmark_id, CAST(d.doc_id % n.n AS BIGINT) AS src_page_id,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE d.doc_id % 20 END AS folder_id,
    CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.source END AS title_override,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.lang END AS notes,
    CASE d.doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'archived' ELSE 'unread' END AS status,
    CASE WHEN d.doc_id % 7 = 0 THEN 1706000000000000 + d.doc_id ELSE NULL END AS deleted_at_us,
    1704000000000000 + d.doc_id AS created_at_us,
    1705000000000000 + (d.doc_id*37 % 1000) AS updated_at_us
  FROM documents d CROSS JOIN n),
bookmarks AS (
  SELECT b.bookmark_id, b.folder_id, b.title_override, b.notes, b.status, b.deleted_at_us, b.created_at_us,
    b.updated_at_us, {_hid('c.canonical_url')} AS page_id
  FROM bm b JOIN pages p ON p.page_id = b.src_page_id JOIN canon c ON c.url = p.url),
folders AS (
  SELECT folder_id, CASE WHEN folder_id > 0 THEN (folder_id - 1) // 2 END AS parent_folder_id
  FROM (SELECT DISTINCT folder_id FROM bookmarks WHERE folder_id IS NOT NULL)),
vectors AS (SELECT vec_id AS page_id, embedding, label FROM embeddings)
"""


def _rule_sql(target_host: str, target_path: str, bare: bool = False) -> dict[str, str]:
    """matched flags, winner index, allowed and the trace as SQL expressions."""
    flags = []
    for position, rule in enumerate(RULES, start=1):
        tgt = f"({target_host} || {target_path})" if "/" in rule else target_host
        flags.append((position, rule[0] == "+", f"({tgt} GLOB {_q(rule[1:])})"))
    winner = "CASE " + " ".join(f"WHEN {f} THEN {i}" for i, _, f in reversed(flags)) + " END"
    allowed = "CASE " + " ".join(f"WHEN {f} THEN {str(plus).upper()}" for _, plus, f in reversed(flags)) + " ELSE TRUE END"
    trace = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} THEN '{i}' END" for i, _, f in flags) + ")"
    return {"winner": winner, "allowed": allowed, "trace": trace}


_URL_RULE = _rule_sql("t.phost", "t.ppath")
_HOST_RULE = _rule_sql("h.host", "'/'")


def _with(extra: str = "") -> str:
    return "WITH " + BASE + ("," + extra if extra else "")


def _decided_urls() -> str:
    return f"""
decided AS (
  SELECT t.target AS url, t.phost, {_URL_RULE['allowed']} AS allowed, {_URL_RULE['winner']} AS rule_index,
    {_URL_RULE['trace']} AS matched_rules
  FROM ptarget t),
annot_r AS (
  SELECT a.*, CASE WHEN a.canonical_url IS NULL OR a.host = '' THEN 'invalid'
      WHEN d.allowed THEN 'allowed' ELSE 'denied' END AS status, d.rule_index
  FROM annot a LEFT JOIN decided d ON d.url = a.canonical_url)
"""


def _page_batch(src: str) -> str:
    return f"""
  SELECT url, host, title, first_seen_us, last_seen_us FROM (
    SELECT canonical_url AS url, host, title,
      min(visited_at_us) OVER (PARTITION BY canonical_url) AS first_seen_us,
      max(visited_at_us) OVER (PARTITION BY canonical_url) AS last_seen_us,
      row_number() OVER (PARTITION BY canonical_url
        ORDER BY browser_rank DESC, profile DESC, visited_at_us ASC, source_visit_id ASC) AS rn
    FROM {src}) WHERE rn = 1"""


def _pages_full(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT {_hid('url')} AS page_id, url, host, title, first_seen_us, last_seen_us, 1 AS normalization_version
  FROM ({_page_batch(src)}))"""


def _merge_pages(name: str, old: str, new: str) -> str:
    return f"""
{name} AS (
  SELECT coalesce(n.page_id, e.page_id) AS page_id, coalesce(n.url, e.url) AS url, coalesce(n.host, e.host) AS host,
    coalesce(n.title, e.title) AS title, least(e.first_seen_us, n.first_seen_us) AS first_seen_us,
    greatest(e.last_seen_us, n.last_seen_us) AS last_seen_us,
    coalesce(e.normalization_version, n.normalization_version) AS normalization_version
  FROM {old} e FULL OUTER JOIN {new} n ON e.url = n.url)"""


def _visit_rows(name: str, src: str) -> str:
    return f"""
{name} AS (
  SELECT {_hid("CAST(source_profile_id AS VARCHAR) || ':' || CAST(source_visit_id AS VARCHAR)")} AS visit_id,
    {_hid('canonical_url')} AS page_id, visited_at_us, title AS title_snapshot, source_profile_id, source_visit_id
  FROM {src})"""


ING = f"""
allowed_all AS (SELECT * FROM annot WHERE canonical_url IS NOT NULL AND host <> ''),
{_pages_full('ipages', 'allowed_all')},
{_visit_rows('ivisits', 'allowed_all')}
"""

_CUT = f"(SELECT t FROM as_of) - {INGEST_DAYS} * {DAY}"
SPLIT = f"""
{_decided_urls()},
ok AS (SELECT * FROM annot_r WHERE status = 'allowed'),
old_b AS (SELECT * FROM ok WHERE visited_at_us < {_CUT}),
new_b AS (SELECT * FROM ok WHERE visited_at_us >= {_CUT}),
{_pages_full('p_old', 'old_b')},
{_pages_full('p_new', 'new_b')},
{_merge_pages('p_after', 'p_old', 'p_new')}
"""


def _tok(expr: str) -> str:
    return (
        f"list_filter(string_split_regex(translate(lower(coalesce({expr}, '')), {_q(ACCENTED)}, {_q(FOLDED)}), "
        r"'[^\pL\pN]+'), lambda x: x <> '')"
    )


QUERY_TEXTS = "(VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(TEXT_QUERIES)) + ") AS qt(qid, text)"


WHOLE_TEXTS = "SELECT doc_id AS qid, text FROM documents WHERE doc_id % 20 = 0"


def _bm25(name: str, k: int, texts: str = WHOLE_TEXTS) -> str:
    return f"""
qtext AS ({texts}),
qterms AS (SELECT DISTINCT qid, unnest({_tok('text')}) AS term FROM qtext),
nterms AS (SELECT qid, count(*) AS n_terms FROM qterms GROUP BY qid),
dtok AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
dstats AS (SELECT count(*) AS N, avg(len(toks)) AS avgdl FROM dtok),
dterm AS (SELECT doc_id, len(toks) AS doc_len, unnest(toks) AS term FROM dtok),
tf AS (
  SELECT doc_id, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM dterm
  WHERE term IN (SELECT term FROM qterms) GROUP BY doc_id, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT q.qid, tf.doc_id,
    sum(ln(1 + ((SELECT N FROM dstats) - f.df + 0.5) / (f.df + 0.5))
        * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.doc_len / (SELECT avgdl FROM dstats)))) AS score,
    count(*) AS n_hit
  FROM tf JOIN dfreq f USING (term) JOIN qterms q USING (term)
  GROUP BY q.qid, tf.doc_id),
{name} AS (
  SELECT qid, doc_id, rank, round(score, 6) AS score FROM (
    SELECT s.qid, s.doc_id, s.score,
      row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 9) DESC, s.doc_id) AS rank
    FROM scored s JOIN nterms t USING (qid) WHERE s.n_hit = t.n_terms) WHERE rank <= {k})"""


def _knn(name: str, k: int) -> str:
    return f"""
vex AS (SELECT page_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors),
dist AS (
  SELECT c.page_id AS qid, v.page_id AS doc_id, sqrt(sum((CAST(v.x AS DOUBLE) - CAST(c.x AS DOUBLE)) * (CAST(v.x AS DOUBLE) - CAST(c.x AS DOUBLE)))) AS d
  FROM vex v JOIN vex c USING (i) WHERE c.page_id % 20 = 0 GROUP BY c.page_id, v.page_id),
{name} AS (
  SELECT qid, doc_id, rank, round(d, 6) AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), doc_id) AS rank FROM dist)
  WHERE rank <= {k})"""


def _models(active: str) -> str:
    return f"""
models0 AS (
  SELECT CAST(label AS BIGINT) + 1 AS model_id, 'model-' || CAST(label AS VARCHAR) AS model_name,
    CAST(max(len(embedding)) AS INTEGER) AS dimensions
  FROM embeddings GROUP BY label),
models_a AS (SELECT *, model_name = {_q(active)} AS is_active FROM models0)"""


REGISTER = f"""
{_models('model-0')},
registry AS (
  SELECT model_id, model_name, CASE WHEN model_name = {_q(ACTIVE_MODEL)} THEN 64 ELSE dimensions END AS dimensions
  FROM models_a
  UNION ALL
  SELECT (SELECT coalesce(max(model_id), 0) + 1 FROM models_a), {_q(ACTIVE_MODEL)}, 64
  WHERE NOT EXISTS (SELECT 1 FROM models_a WHERE model_name = {_q(ACTIVE_MODEL)})),
models_r AS (SELECT *, model_name = {_q(ACTIVE_MODEL)} AS is_active FROM registry)
"""


def _closure() -> str:
    return """
up AS (
  WITH RECURSIVE u(folder_id, ancestor_id, depth) AS (
    SELECT folder_id, folder_id, 0 FROM folders
    UNION ALL
    SELECT u.folder_id, f.parent_folder_id, u.depth + 1 FROM u JOIN folders f ON f.folder_id = u.ancestor_id
    WHERE f.parent_folder_id IS NOT NULL)
  SELECT * FROM u)"""


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["recent_visits"] = _with() + f"""
SELECT v.browser, v.profile, v.visit_id AS source_visit_id, p.url AS raw_url, coalesce(p.title, '') AS raw_title,
  coalesce(v.visit_date, 0) AS visited_at_us
FROM visits v JOIN places p USING (place_id)
WHERE p.url IS NOT NULL AND trim(p.url) <> '' AND coalesce(v.visit_date, 0) >= (SELECT t FROM as_of) - {RECENT_DAYS} * {DAY}
"""

ORACLE_SQL["history_topk"] = _with() + f"""
SELECT s.browser, s.profile, {_clean('s.title')} AS title, s.url, c.canonical_url, s.last_visit_date
FROM (SELECT *, row_number() OVER (PARTITION BY browser, profile ORDER BY last_visit_date DESC, id DESC) AS rn
      FROM snap WHERE url IS NOT NULL AND trim(url) <> '') s
JOIN canon c USING (url)
WHERE s.rn <= {LIMIT_PER_PROFILE} AND c.canonical_url IS NOT NULL
"""

ORACLE_SQL["normalize_urls"] = _with() + f"""
SELECT p.place_id, p.url, c.canonical_url, {_clean('p.title')} AS title,
  CASE WHEN c.canonical_url IS NOT NULL THEN c.host END AS host
FROM places p JOIN canon c USING (url)
"""

ORACLE_SQL["dedupe_history"] = _with() + "SELECT * FROM deduped"

ORACLE_SQL["history_preview_input"] = _with(
    f"""
pd AS (
  SELECT d.*, {_URL_RULE['allowed']} AS allowed FROM deduped d JOIN ptarget t ON t.target = d.canonical_url)"""
) + f"""
SELECT browser, profile, title, url, canonical_url, last_visit_date,
  'title: ' || title || chr(10) || 'url: ' || canonical_url AS embedding_input
FROM pd WHERE allowed
ORDER BY last_visit_date DESC, canonical_url, title
LIMIT {MAX_ITEMS}
"""

ORACLE_SQL["policy_trace"] = _with() + f"""
SELECT t.target AS url, t.phost AS host, {_URL_RULE['allowed']} AS allowed, {_URL_RULE['winner']} AS rule_index,
  {_URL_RULE['trace']} AS matched_rules
FROM ptarget t
"""

_HOSTS = f"""
hosts AS (
  SELECT DISTINCT host FROM annot
  WHERE canonical_url IS NOT NULL AND host <> '' AND visited_at_us >= (SELECT t FROM as_of) - {INGEST_DAYS} * {DAY}),
hdec AS (
  SELECT h.host, {_HOST_RULE['allowed']} AS allowed, {_HOST_RULE['winner']} AS rule_index,
    {_HOST_RULE['trace']} AS matched_rules
  FROM hosts h)"""

ORACLE_SQL["policy_preview"] = _with(_HOSTS) + "SELECT * FROM hdec ORDER BY host"

ORACLE_SQL["policy_preview_counts"] = _with(_HOSTS) + """
SELECT count(*) AS total, count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS denied
FROM hdec
"""

ORACLE_SQL["page_upsert"] = _with(SPLIT) + "SELECT * FROM p_after"

ORACLE_SQL["incremental_merge"] = _with(_decided_urls()) + f"""
SELECT {_hid('canonical_url')} AS page_id, canonical_url AS url, max_by(title, (visited_at_us, title)) AS title,
  min(visited_at_us) AS first_seen_us, max(visited_at_us) AS last_seen_us,
  count(DISTINCT (source_profile_id, source_visit_id)) AS n_visits
FROM annot_r WHERE status = 'allowed' GROUP BY canonical_url
"""

ORACLE_SQL["profile_register"] = _with(
    f"""
stores AS (SELECT DISTINCT browser, store_path FROM vis),
prof AS (
  SELECT {_hid("browser || ':' || store_path")} AS source_profile_id, browser,
    sha256(browser || ':' || store_path) AS profile_key, CAST(NULL AS VARCHAR) AS label
  FROM stores)"""
) + """
SELECT *, FALSE AS is_new FROM prof WHERE browser = 'zen'
UNION ALL
SELECT *, TRUE AS is_new FROM prof WHERE browser <> 'zen'
"""

ORACLE_SQL["ingest_summary"] = _with(_decided_urls()) + f"""
SELECT (SELECT count(*) FROM (SELECT DISTINCT browser, profile FROM visits)) AS discovered_profiles,
  count(*) AS source_rows,
  count(DISTINCT canonical_url) FILTER (WHERE status = 'allowed') AS pages_touched,
  count(*) FILTER (WHERE status = 'allowed') AS visits_inserted,
  count(*) FILTER (WHERE status = 'allowed') AS filtered_allowed_rows,
  count(*) FILTER (WHERE status = 'denied') AS filtered_denied_rows
FROM annot_r WHERE visited_at_us >= (SELECT t FROM as_of) - {INGEST_DAYS} * {DAY}
"""

_BTEXT = """
btext AS (
  SELECT page_id, string_agg(trim(coalesce(title_override, '') || ' ' || coalesce(notes, '')), ' ' ORDER BY bookmark_id)
    AS bookmark_text
  FROM bookmarks WHERE deleted_at_us IS NULL GROUP BY page_id),
sdocs AS (
  SELECT p.page_id, p.title, p.url, coalesce(b.bookmark_text, '') AS bookmark_text
  FROM ipages p LEFT JOIN btext b USING (page_id))"""

ORACLE_SQL["search_documents"] = _with(ING + "," + _BTEXT) + "SELECT * FROM sdocs"

ORACLE_SQL["embedding_candidates"] = _with(
    ING
    + """,
pc AS (
  SELECT page_id, t, url AS u, regexp_replace(url, '[?#].*$', '') AS bare
  FROM (SELECT page_id, title AS t, url FROM ipages)),
cands AS (
  SELECT page_id,
    unnest([
      'title: ' || t || chr(10) || 'url: ' || u,
      'title: ' || substring(t, 1, 512) || chr(10) || 'url: ' || substring(u, 1, 2048),
      'title: ' || substring(t, 1, 256) || chr(10) || 'url: ' || substring(bare, 1, 1024),
      'title: ' || substring(t, 1, 128) || chr(10) || 'url: ' || substring(bare, 1, 512),
      'url: ' || substring(bare, 1, 512),
      'url: ' || substring(u, 1, 512)]) AS text,
    unnest([1, 2, 3, 4, 5, 6]) AS pos
  FROM pc),
firsts AS (SELECT page_id, text, min(pos) AS pos FROM cands GROUP BY page_id, text)"""
) + """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS attempt, text FROM firsts
"""

ORACLE_SQL["content_hash_changes"] = _with(SPLIT) + """
SELECT a.page_id, sha256(a.title || chr(10) || a.url) AS content_hash,
  CASE WHEN o.page_id IS NULL THEN 'new'
       WHEN sha256(o.title || chr(10) || o.url) <> sha256(a.title || chr(10) || a.url) THEN 'changed'
       ELSE 'unchanged' END AS reason,
  NOT (o.page_id IS NOT NULL AND sha256(o.title || chr(10) || o.url) = sha256(a.title || chr(10) || a.url))
    AS needs_embedding
FROM p_after a LEFT JOIN p_old o USING (page_id)
"""

ORACLE_SQL["embedding_replace"] = _with(
    """
fresh AS (SELECT page_id, list_transform(embedding, lambda x: x * CAST(2.0 AS FLOAT)) AS embedding FROM vectors WHERE label < 5),
replaced AS (
  SELECT page_id, embedding FROM vectors WHERE page_id NOT IN (SELECT page_id FROM fresh)
  UNION ALL SELECT page_id, embedding FROM fresh)"""
) + """
SELECT page_id, round(list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b), 4) AS vector_sum,
  len(embedding) AS dims
FROM replaced
"""

ORACLE_SQL["vector_preview"] = _with() + """
SELECT page_id, label,
  array_to_string(list_transform(embedding[1:10], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ', ') AS preview_text,
  'history,preview' AS tags
FROM vectors
"""

ORACLE_SQL["search_exact"] = _with(ING) + """
SELECT p.place_id, p.url, c.canonical_url, g.page_id, g.host
FROM places p JOIN canon c USING (url) JOIN ipages g ON g.url = c.canonical_url
"""

ORACLE_SQL["search_bm25"] = _with(_bm25("bm25hits", TOP_K)) + "SELECT * FROM bm25hits"

ORACLE_SQL["search_bm25_texts"] = _with(_bm25("bm25hits", TOP_K, f"SELECT qid::BIGINT AS qid, text FROM {QUERY_TEXTS}")) + "SELECT * FROM bm25hits"

ORACLE_SQL["search_pages"] = _with(ING + "," + _BTEXT) + f"""
,ptok AS (SELECT page_id, {_tok('title')} AS a, {_tok('url')} AS b, {_tok('bookmark_text')} AS c FROM sdocs),
plen AS (SELECT *, {FIELD_WEIGHTS[0]}::DOUBLE * len(a) + {FIELD_WEIGHTS[1]}::DOUBLE * len(b) + {FIELD_WEIGHTS[2]}::DOUBLE * len(c) AS dl FROM ptok),
pstats AS (SELECT count(*) AS N, avg(dl) AS avgdl FROM plen),
pterm AS (
  SELECT page_id, dl, unnest(a) AS term, {FIELD_WEIGHTS[0]}::DOUBLE AS w FROM plen
  UNION ALL SELECT page_id, dl, unnest(b), {FIELD_WEIGHTS[1]} FROM plen
  UNION ALL SELECT page_id, dl, unnest(c), {FIELD_WEIGHTS[2]} FROM plen),
tf AS (SELECT page_id, term, sum(w) AS tf, any_value(dl) AS dl FROM pterm GROUP BY page_id, term),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qterms AS (SELECT DISTINCT page_id AS qid, unnest(a) AS term FROM ptok WHERE page_id % 20 = 0),
nterms AS (SELECT qid, count(*) AS n_terms FROM qterms GROUP BY qid),
scored AS (
  SELECT q.qid, tf.page_id, count(*) AS n_hit,
    sum(ln(1 + ((SELECT N FROM pstats) - f.df + 0.5) / (f.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / (SELECT avgdl FROM pstats)))) AS score
  FROM tf JOIN dfreq f USING (term) JOIN qterms q USING (term) GROUP BY q.qid, tf.page_id)
SELECT qid, page_id, rank, round(score, 6) AS score FROM (
  SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, page_id) AS rank
  FROM scored s JOIN nterms USING (qid) WHERE n_hit = n_terms) WHERE rank <= {TOP_K}
"""

ORACLE_SQL["search_knn"] = _with(_knn("kn", TOP_K)) + "SELECT * FROM kn"

ORACLE_SQL["search_hybrid"] = _with(_bm25("bmh", HYBRID_DEPTH) + "," + _knn("kn", HYBRID_DEPTH)) + f"""
SELECT qid, doc_id, rank, kw_rank, vec_rank, round(rrf, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rrf, 9) DESC, doc_id) AS rank FROM (
    SELECT coalesce(b.qid, k.qid) AS qid, coalesce(b.doc_id, k.doc_id) AS doc_id, b.rank AS kw_rank, k.rank AS vec_rank,
      coalesce(1.0 / (60 + b.rank), 0.0) + coalesce(1.0 / (60 + k.rank), 0.0) AS rrf
    FROM bmh b FULL OUTER JOIN kn k ON b.qid = k.qid AND b.doc_id = k.doc_id))
WHERE rank <= {TOP_K}
"""

ORACLE_SQL["recent_pages"] = _with(ING) + "SELECT * FROM ipages ORDER BY last_seen_us DESC, page_id LIMIT 20"

ORACLE_SQL["recent_pages_by_host"] = _with(ING) + """
SELECT host, page_id, url, last_seen_us, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY last_seen_us DESC, page_id) AS INTEGER) AS rank
  FROM ipages) WHERE rank <= 3
"""

ORACLE_SQL["page_timeline"] = _with(ING) + """
SELECT v.page_id, p.url, p.host, v.visit_id, v.visited_at_us, v.visit_rank, v.previous_visit_us FROM (
  SELECT page_id, visit_id, visited_at_us,
    CAST(row_number() OVER w AS INTEGER) AS visit_rank, lead(visited_at_us) OVER w AS previous_visit_us
  FROM ivisits WINDOW w AS (PARTITION BY page_id ORDER BY visited_at_us DESC, visit_id DESC)) v
JOIN ipages p USING (page_id) WHERE v.visit_rank <= 5
"""

ORACLE_SQL["visits_in_range"] = _with(ING) + f"""
SELECT * FROM ivisits
WHERE visited_at_us >= (SELECT t FROM as_of) - {DAY} AND visited_at_us < (SELECT t FROM as_of)
"""

ORACLE_SQL["bookmarks_by_status"] = _with() + """
SELECT status, bookmark_id, page_id, updated_at_us, status_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY status ORDER BY updated_at_us DESC, bookmark_id) AS INTEGER)
    AS status_rank
  FROM bookmarks WHERE deleted_at_us IS NULL) WHERE status_rank <= 10
"""

ORACLE_SQL["bookmarks_by_folder"] = _with() + """
SELECT folder_id, bookmark_id, page_id, updated_at_us, folder_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY updated_at_us DESC, bookmark_id) AS INTEGER)
    AS folder_rank
  FROM bookmarks WHERE deleted_at_us IS NULL AND folder_id IS NOT NULL) WHERE folder_rank <= 5
"""

ORACLE_SQL["folder_tree"] = _with(
    _closure()
    + """,
perf AS (SELECT folder_id, count(*) AS n FROM bookmarks WHERE deleted_at_us IS NULL GROUP BY folder_id)"""
) + """
SELECT s.folder_id, s.subtree_bookmarks, s.subtree_folders, l.level FROM (
  SELECT u.ancestor_id AS folder_id, coalesce(sum(p.n), 0) AS subtree_bookmarks, count(*) AS subtree_folders
  FROM up u LEFT JOIN perf p ON p.folder_id = u.folder_id GROUP BY u.ancestor_id) s
JOIN (SELECT folder_id, max(depth) AS level FROM up GROUP BY folder_id) l USING (folder_id)
"""

ORACLE_SQL["integrity_audit"] = _with(
    ING
    + ","
    + _models(ACTIVE_MODEL)
    + """,
prof AS (
  SELECT DISTINCT """
    + _hid("browser || ':' || store_path")
    + """ AS source_profile_id, sha256(browser || ':' || store_path) AS profile_key FROM vis)"""
) + """
SELECT 'pages.url unique' AS "check", url AS key, count(*) AS n FROM ipages GROUP BY url HAVING count(*) > 1
UNION ALL SELECT 'pages.page_id unique', CAST(page_id AS VARCHAR), count(*) FROM ipages GROUP BY page_id HAVING count(*) > 1
UNION ALL SELECT 'pages not null', '*', count(*) FROM ipages
  WHERE url IS NULL OR host IS NULL OR title IS NULL OR first_seen_us IS NULL OR last_seen_us IS NULL
  OR normalization_version IS NULL HAVING count(*) > 0
UNION ALL SELECT 'visits (profile, source visit) unique', CAST(source_profile_id AS VARCHAR) || '|' || CAST(source_visit_id AS VARCHAR),
  count(*) FROM ivisits GROUP BY source_profile_id, source_visit_id HAVING count(*) > 1
UNION ALL SELECT 'visits.page_id -> pages', CAST(page_id AS VARCHAR), count(*) FROM ivisits
  WHERE page_id NOT IN (SELECT page_id FROM ipages) GROUP BY page_id
UNION ALL SELECT 'visits.source_profile_id -> profiles', CAST(source_profile_id AS VARCHAR), count(*) FROM ivisits
  WHERE source_profile_id NOT IN (SELECT source_profile_id FROM prof) GROUP BY source_profile_id
UNION ALL SELECT 'profiles.profile_key unique', profile_key, count(*) FROM prof GROUP BY profile_key HAVING count(*) > 1
UNION ALL SELECT 'bookmarks.page_id -> pages', CAST(page_id AS VARCHAR), count(*) FROM bookmarks
  WHERE page_id NOT IN (SELECT page_id FROM ipages) GROUP BY page_id
UNION ALL SELECT 'bookmarks.folder_id -> folders', CAST(folder_id AS VARCHAR), count(*) FROM bookmarks
  WHERE folder_id IS NOT NULL AND folder_id NOT IN (SELECT folder_id FROM folders) GROUP BY folder_id
UNION ALL SELECT 'folders.parent -> folders', CAST(parent_folder_id AS VARCHAR), count(*) FROM folders
  WHERE parent_folder_id IS NOT NULL AND parent_folder_id NOT IN (SELECT folder_id FROM folders) GROUP BY parent_folder_id
UNION ALL SELECT 'page_embeddings.page_id -> pages', CAST(page_id AS VARCHAR), count(*) FROM vectors
  WHERE page_id NOT IN (SELECT page_id FROM ipages) GROUP BY page_id
UNION ALL SELECT 'page_embeddings.model_id -> models', CAST(CAST(label AS BIGINT) + 1 AS VARCHAR), count(*) FROM vectors
  WHERE CAST(label AS BIGINT) + 1 NOT IN (SELECT model_id FROM models_a) GROUP BY label
UNION ALL SELECT 'models.model_name unique', model_name, count(*) FROM models_a GROUP BY model_name HAVING count(*) > 1
UNION ALL SELECT 'models.dimensions > 0', model_name, 1 FROM models_a WHERE dimensions <= 0
UNION ALL SELECT 'exactly one active model', CAST(a AS VARCHAR), 1 FROM (
  SELECT count(*) FILTER (WHERE is_active) AS a FROM models_a) WHERE a <> 1
"""

ORACLE_SQL["cascade_purge"] = _with(
    ING
    + ","
    + _BTEXT
    + ","
    + _closure()
    + """,
doomed AS (SELECT page_id FROM ipages WHERE host GLOB '*.example.org'),
dfold AS (SELECT DISTINCT folder_id FROM up WHERE ancestor_id = 3),
kept_bm AS (
  SELECT b.*, b.folder_id IN (SELECT folder_id FROM dfold) AS nulled FROM bookmarks b
  WHERE b.page_id NOT IN (SELECT page_id FROM doomed))"""
) + """
SELECT 'pages' AS "table", (SELECT count(*) FROM ipages) AS rows_before,
  (SELECT count(*) FROM ipages WHERE page_id NOT IN (SELECT page_id FROM doomed)) AS rows_after, 0 AS rows_nulled
UNION ALL SELECT 'visits', (SELECT count(*) FROM ivisits),
  (SELECT count(*) FROM ivisits WHERE page_id NOT IN (SELECT page_id FROM doomed)), 0
UNION ALL SELECT 'bookmarks', (SELECT count(*) FROM bookmarks), (SELECT count(*) FROM kept_bm),
  (SELECT count(*) FROM kept_bm WHERE nulled)
UNION ALL SELECT 'folders', (SELECT count(*) FROM folders),
  (SELECT count(*) FROM folders WHERE folder_id NOT IN (SELECT folder_id FROM dfold)), 0
UNION ALL SELECT 'documents', (SELECT count(*) FROM sdocs),
  (SELECT count(*) FROM sdocs WHERE page_id NOT IN (SELECT page_id FROM doomed)), 0
"""

_EXPORTED = ("first_seen_us", "host", "last_seen_us", "normalization_version", "page_id", "title", "url")
ORACLE_SQL["export_pages"] = _with(ING) + f"""
,k AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS i, count(*) OVER () AS n FROM ipages),
points AS (SELECT DISTINCT page_id FROM k JOIN range(1, {EXPORT_PARTS}) t(j) ON i = n * j // {EXPORT_PARTS} AND j < n),
h AS (
  SELECT (SELECT count(*) FROM points p WHERE p.page_id <= g.page_id)::INTEGER AS part,
    {_hid("concat_ws(chr(10), " + ", ".join(f"concat('{{' || chr(34) || 'v' || chr(34) || ':', to_json({c}), '}}')" for c in _EXPORTED) + ")")} AS h
  FROM ipages g)
SELECT part, count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS digest FROM h GROUP BY part
"""

_PROF = f"""
prof AS (
  SELECT DISTINCT {_hid("browser || ':' || store_path")} AS source_profile_id, browser, sha256(browser || ':' || store_path) AS profile_key FROM vis),
pemb AS (SELECT page_id, last_seen_us // {DAY} % 7 + 1 AS model_id FROM ipages)"""

ORACLE_SQL["constraint_audit"] = _with(ING + "," + _BTEXT + "," + _models("model-0") + "," + _PROF + """,
kp AS (SELECT * FROM ipages WHERE host NOT LIKE '%.example.org'),
kv AS (SELECT * FROM ivisits UNION ALL SELECT * FROM ivisits WHERE source_visit_id % 20 = 0),
kf AS (SELECT * FROM folders WHERE folder_id <> 3),
km AS (SELECT * FROM models_a WHERE model_id <> 2)""") + """
SELECT 'pages' AS "table", 'title not null' AS "constraint", '*' AS key, count(*) AS n FROM kp WHERE title = '(untitled)' HAVING count(*) > 0
UNION ALL SELECT 'visits', 'visit_id unique', CAST(visit_id AS VARCHAR), count(*) FROM kv GROUP BY visit_id HAVING count(*) > 1
UNION ALL SELECT 'visits', '(source_profile_id, source_visit_id) unique', source_profile_id || '|' || source_visit_id, count(*)
  FROM kv GROUP BY source_profile_id, source_visit_id HAVING count(*) > 1
UNION ALL SELECT 'visits', 'page_id in pages', CAST(page_id AS VARCHAR), count(*) FROM kv WHERE page_id NOT IN (SELECT page_id FROM kp) GROUP BY page_id
UNION ALL SELECT 'visits', 'source_profile_id in source_profiles', CAST(source_profile_id AS VARCHAR), count(*)
  FROM kv WHERE source_profile_id NOT IN (SELECT source_profile_id FROM prof WHERE browser <> 'zen') GROUP BY source_profile_id
UNION ALL SELECT 'bookmark_folders', 'parent_folder_id in bookmark_folders', CAST(parent_folder_id AS VARCHAR), count(*)
  FROM kf WHERE parent_folder_id NOT IN (SELECT folder_id FROM kf) GROUP BY parent_folder_id
UNION ALL SELECT 'bookmarks', 'page_id in pages', CAST(page_id AS VARCHAR), count(*) FROM bookmarks WHERE page_id NOT IN (SELECT page_id FROM kp) GROUP BY page_id
UNION ALL SELECT 'bookmarks', 'folder_id in bookmark_folders', CAST(folder_id AS VARCHAR), count(*)
  FROM bookmarks WHERE folder_id NOT IN (SELECT folder_id FROM kf) GROUP BY folder_id
UNION ALL SELECT 'embedding_models', 'dimensions > 0', '*', count(*) FROM km WHERE model_id = 4 HAVING count(*) > 0
UNION ALL SELECT 'embedding_models', 'exactly one active', '*', count(*) FROM km HAVING count(*) <> 1
UNION ALL SELECT 'page_embeddings', 'page_id in pages', CAST(page_id AS VARCHAR), count(*) FROM pemb WHERE page_id NOT IN (SELECT page_id FROM kp) GROUP BY page_id
UNION ALL SELECT 'page_embeddings', 'model_id in embedding_models', CAST(model_id AS VARCHAR), count(*)
  FROM pemb WHERE model_id NOT IN (SELECT model_id FROM km) GROUP BY model_id
UNION ALL SELECT 'page_text', 'page_id in pages', CAST(page_id AS VARCHAR), count(*) FROM sdocs WHERE page_id NOT IN (SELECT page_id FROM kp) GROUP BY page_id
"""

ORACLE_SQL["constraint_purge"] = _with(ING + "," + _BTEXT + "," + _models("model-0") + "," + _PROF + "," + _closure() + """,
kp AS (SELECT page_id FROM ipages WHERE host NOT LIKE '%.example.org'),
kpr AS (SELECT * FROM prof WHERE browser <> 'firefox'),
gone AS (SELECT DISTINCT folder_id FROM up WHERE ancestor_id = 3),
kb AS (SELECT folder_id IN (SELECT folder_id FROM gone) AS nulled FROM bookmarks WHERE page_id IN (SELECT page_id FROM kp))""") + """
SELECT 'source_profiles' AS "table", (SELECT count(*) FROM prof) AS rows_before, (SELECT count(*) FROM kpr) AS rows_after, 0 AS rows_nulled
UNION ALL SELECT 'pages', (SELECT count(*) FROM ipages), (SELECT count(*) FROM kp), 0
UNION ALL SELECT 'visits', (SELECT count(*) FROM ivisits), (SELECT count(*) FROM ivisits
  WHERE page_id IN (SELECT page_id FROM kp) AND source_profile_id IN (SELECT source_profile_id FROM kpr)), 0
UNION ALL SELECT 'bookmark_folders', (SELECT count(*) FROM folders), (SELECT count(*) FROM folders WHERE folder_id NOT IN (SELECT folder_id FROM gone)), 0
UNION ALL SELECT 'bookmarks', (SELECT count(*) FROM bookmarks), (SELECT count(*) FROM kb), (SELECT count(*) FROM kb WHERE nulled)
UNION ALL SELECT 'embedding_models', (SELECT count(*) FROM models_a), (SELECT count(*) FROM models_a), 0
UNION ALL SELECT 'page_embeddings', (SELECT count(*) FROM pemb), (SELECT count(*) FROM pemb WHERE page_id IN (SELECT page_id FROM kp)), 0
UNION ALL SELECT 'page_text', (SELECT count(*) FROM sdocs), (SELECT count(*) FROM sdocs WHERE page_id IN (SELECT page_id FROM kp)), 0
"""

ORACLE_SQL["model_registry"] = _with(REGISTER) + "SELECT model_id, model_name, dimensions, is_active FROM models_r"

ORACLE_SQL["active_vectors"] = _with(
    REGISTER
    + """,
meta AS (
  SELECT v.page_id, m.model_id FROM vectors v
  JOIN models_r m ON m.model_name = CASE WHEN v.label % 2 = 0 THEN 'model-0' ELSE """
    + _q(ACTIVE_MODEL)
    + """ END)"""
) + """
SELECT m.page_id, m.model_id, len(v.embedding) AS dims
FROM meta m JOIN models_r r ON r.model_id = m.model_id AND r.is_active JOIN vectors v ON v.page_id = m.page_id
WHERE len(v.embedding) = r.dimensions
"""

ORACLE_SQL["model_counts"] = _with(REGISTER) + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM models_r
"""

# over whole tables
ORACLE_SQL["policy_filter_all"] = _with(_decided_urls()) + """
SELECT browser, profile, source_visit_id, canonical_url, host, rule_index
FROM annot_r
WHERE status = 'allowed'
"""

ORACLE_SQL["visit_insert_ignore_all"] = _with(
    _decided_urls()
    + f""",
every AS (SELECT * FROM annot_r WHERE status = 'allowed'),
older AS (SELECT * FROM every WHERE visited_at_us < (SELECT t FROM as_of) - {INGEST_DAYS} * {DAY}),
{_visit_rows('v_old', 'older')},
{_visit_rows('v_new', 'every')}"""
) + """
SELECT *, FALSE AS is_new FROM v_old
UNION ALL
SELECT n.*, TRUE AS is_new FROM v_new n
WHERE NOT EXISTS (SELECT 1 FROM v_old o WHERE o.source_profile_id = n.source_profile_id
                  AND o.source_visit_id = n.source_visit_id)
"""

ORACLE_SQL["snapshot_summary_all"] = _with(
    f"""
pd AS (
  SELECT d.*, {_URL_RULE['allowed']} AS allowed FROM deduped d JOIN ptarget t ON t.target = d.canonical_url)"""
) + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT browser, profile FROM snap)) AS discovered_profile_count,
  (SELECT count(*) FROM entries) AS loaded_row_count,
  (SELECT count(*) FROM pd WHERE allowed) AS deduped_row_count
"""

for _name in ("policy_filter", "visit_insert_ignore", "snapshot_summary"):
    ORACLE_SQL[_name] = ORACLE_SQL[f"{_name}_all"]
