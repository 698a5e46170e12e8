"""URL canonicalisation as staged Column projections (no UDF, no ``parse_url``).

The split follows Python's ``urllib.parse.urlsplit``: scheme, optional
``//netloc``, path, query, fragment. Each stage is one projection, so every
regular expression runs once per row and the plan stays inside whole-stage
codegen (Spark does not merge projections that would repeat a non-trivial
expression).

Canonical form:
  * surrounding Unicode whitespace stripped; empty -> null
  * no scheme -> null; http(s) with no host -> null
  * a port that is not ASCII digits or is > 65535 -> null (only checked when a host exists)
  * scheme and host lower-cased, userinfo kept verbatim
  * :80 dropped for http and :443 for https; other ports written as integers
  * empty path -> "/", query kept verbatim (an empty "?" disappears), fragment dropped
"""

from __future__ import annotations

from urllib.parse import uses_netloc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as whitespace.
PY_WHITESPACE_CLASS = (
    "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
)

# scheme ":" ["//" netloc] path ["?" query] ["#" fragment]
SPLIT_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Hosts inside brackets must be IPv6 (optionally with a zone) or IPvFuture.
_BRACKET_HOST_RE = (
    r"^(?:v[0-9A-Fa-f]+\..+|"
    r"(?=[0-9A-Fa-f:.]*:)[0-9A-Fa-f:]*(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?:%.+)?)$"
)

_NETLOC_SCHEMES = sorted(s for s in uses_netloc if s)



def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip_col(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")


class _Stages:
    """Adds helper columns stage by stage and drops them at the end.

    Helper names derive from the output column, so deriving the same table
    twice gives identical plans and Spark can reuse the shuffles between them.
    """

    def __init__(self, df: DataFrame, out: str):
        self.df = df
        self.tag = f"__{out}_"
        self.names: list[str] = []

    def add(self, **cols: Column) -> None:
        named = {self.tag + k: v for k, v in cols.items()}
        self.names.extend(named)
        self.df = self.df.withColumns(named)

    def __getitem__(self, k: str) -> Column:
        return F.col(self.tag + k)

    def finish(self, **out: Column) -> DataFrame:
        # Filters on the outputs must not be inlined through every stage (the
        # predicate would grow with each substitution), so the final
        # projection carries a no-op guard the optimizer will not push through.
        guard = F.spark_partition_id() >= F.lit(0)
        guarded = {k: F.when(guard, v) for k, v in out.items()}
        return self.df.withColumns(guarded).drop(*self.names)


def _split_stage(s: _Stages, src: Column, prefix: str) -> None:
    s.add(**{
        f"{prefix}scheme": F.lower(F.regexp_extract(src, SPLIT_RE, 1)),
        f"{prefix}netloc": F.regexp_extract(src, SPLIT_RE, 3),
        f"{prefix}path": F.regexp_extract(src, SPLIT_RE, 4),
        f"{prefix}query": F.regexp_extract(src, SPLIT_RE, 5),
    })


def _host_stage(s: _Stages, prefix: str) -> None:
    """hostname, port, username, password and bracket validity from ``{prefix}netloc``."""
    netloc = s[f"{prefix}netloc"]
    s.add(**{
        f"{prefix}hostinfo": F.regexp_extract(netloc, r"([^@]*)$", 1),
        f"{prefix}userinfo": F.when(netloc.contains("@"), F.regexp_extract(netloc, r"(?s)^(.*)@", 1)).otherwise(F.lit("")),
    })
    hostinfo = s[f"{prefix}hostinfo"]
    has_lb = hostinfo.contains("[")
    s.add(**{
        f"{prefix}bhost": F.when(has_lb, F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)).otherwise(
            F.regexp_extract(hostinfo, r"^([^\]]*)", 1)
        ),
        f"{prefix}after_rb": F.regexp_extract(hostinfo, r"(?s)^[^\]]*\](.*)$", 1),
        f"{prefix}before_lb": F.regexp_extract(hostinfo, r"(?s)^([^\[]*)\[", 1),
        f"{prefix}plain_host": F.regexp_extract(hostinfo, r"^([^:]*)", 1),
        f"{prefix}plain_port": F.regexp_extract(hostinfo, r"(?s)^[^:]*:(.*)$", 1),
        f"{prefix}username": F.regexp_extract(s[f"{prefix}userinfo"], r"(?s)^([^:]*)", 1),
        f"{prefix}password": F.regexp_extract(s[f"{prefix}userinfo"], r"(?s)^[^:]*:(.*)$", 1),
    })
    any_lb = netloc.contains("[")
    any_rb = netloc.contains("]")
    after_rb = s[f"{prefix}after_rb"]
    s.add(**{
        f"{prefix}brackets_ok": F.when(any_lb != any_rb, F.lit(False))
        .when(~any_lb, F.lit(True))
        .when(has_lb & (s[f"{prefix}before_lb"] != ""), F.lit(False))
        .when(has_lb & (after_rb != "") & ~after_rb.startswith(":"), F.lit(False))
        .otherwise(s[f"{prefix}bhost"].rlike(_BRACKET_HOST_RE)),
        f"{prefix}hostname": F.when(has_lb, s[f"{prefix}bhost"]).otherwise(s[f"{prefix}plain_host"]),
        f"{prefix}port": F.when(has_lb, F.regexp_extract(after_rb, r"(?s)^:(.*)$", 1)).otherwise(s[f"{prefix}plain_port"]),
    })


def with_canonical_url(df: DataFrame, src: str | Column, out: str = "canonical_url") -> DataFrame:
    """Add ``out``: the canonical URL of ``src``, or null when it is not a usable URL."""
    s = _Stages(df, out)
    raw = _c(src)
    s.add(strip=py_strip_col(raw))
    # urlsplit also drops leading C0 controls/space and every tab/CR/LF.
    s.add(v=F.regexp_replace(F.regexp_replace(s["strip"], r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""))
    _split_stage(s, s["v"], "")
    _host_stage(s, "")
    scheme, netloc, path, query = s["scheme"], s["netloc"], s["path"], s["query"]
    port_raw = s["port"]
    digits_ok = port_raw.rlike(r"^[0-9]+$")
    s.add(
        host=F.lower(s["hostname"]),
        port_digits=F.when(digits_ok, F.regexp_replace(port_raw, r"^0+(?=.)", "")),
    )
    pd_ = s["port_digits"]
    s.add(port_num=F.when(pd_.isNotNull() & (F.length(pd_) <= 5), pd_.cast("int")))
    host, port_num = s["host"], s["port_num"]
    port_ok = (port_raw == "") | (port_num.isNotNull() & (port_num <= 65535))
    default_port = ((scheme == "http") & (port_num == 80)) | ((scheme == "https") & (port_num == 443))
    port_part = F.when(port_num.isNull() | default_port, F.lit("")).otherwise(F.concat(F.lit(":"), port_num.cast("string")))
    user = s["username"]
    userinfo = F.when(
        user != "",
        F.concat(user, F.when(s["password"] != "", F.concat(F.lit(":"), s["password"])).otherwise(F.lit("")), F.lit("@")),
    ).otherwise(F.lit(""))
    s.add(
        netloc_out=F.when(host != "", F.concat(userinfo, host, port_part)).otherwise(F.lower(netloc)),
        path_out=F.when(path == "", F.lit("/")).otherwise(path),
        invalid=(s["strip"] == "")
        | (scheme == "")
        | ~s["brackets_ok"]
        | (scheme.isin("http", "https") & (host == ""))
        | ((host != "") & ~port_ok),
    )
    netloc_out, path_out = s["netloc_out"], s["path_out"]
    body = (
        F.when(
            netloc_out != "",
            F.concat(
                F.lit("//"), netloc_out, F.when(path_out.startswith("/"), path_out).otherwise(F.concat(F.lit("/"), path_out))
            ),
        )
        .when(path_out.startswith("//"), F.concat(F.lit("//"), path_out))
        .when(scheme.isin(*_NETLOC_SCHEMES) & path_out.startswith("/"), F.concat(F.lit("//"), path_out))
        .otherwise(path_out)
    )
    result = F.concat(scheme, F.lit(":"), body, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return s.finish(**{out: F.when(raw.isNull() | s["invalid"], F.lit(None).cast("string")).otherwise(result)})


def with_url_host(df: DataFrame, src: str | Column, out: str = "host") -> DataFrame:
    """Add ``out``: lower-cased hostname of a (canonical) URL, '' when it has none."""
    s = _Stages(df, out)
    s.add(netloc=F.regexp_extract(_c(src), SPLIT_RE, 3))
    _host_stage(s, "")
    return s.finish(**{out: F.coalesce(F.lower(s["hostname"]), F.lit(""))})


def with_url_without_query(df: DataFrame, src: str | Column, out: str) -> DataFrame:
    """Add ``out``: scheme://netloc/path of ``src`` with query and fragment removed."""
    s = _Stages(df, out)
    c = _c(src)
    _split_stage(s, c, "")
    s.add(raw_scheme=F.regexp_extract(c, SPLIT_RE, 1))
    scheme, netloc, path = s["scheme"], s["netloc"], s["path"]
    body = (
        F.when(
            netloc != "",
            F.concat(F.lit("//"), netloc, F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))),
        )
        .when(path.startswith("//"), F.concat(F.lit("//"), path))
        .when(scheme.isin(*_NETLOC_SCHEMES) & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    return s.finish(**{out: F.when(s["raw_scheme"] != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)})


def with_policy_target(df: DataFrame, src: str | Column, host_out: str, path_out: str) -> DataFrame:
    """Add the (host, path) that policy rules are matched against.

    Input may be a bare host, host/path or a full URL. Everything is
    lower-cased (paths too); query and fragment are ignored; trailing dots
    on the host are removed; path defaults to "/".
    """
    s = _Stages(df, host_out)
    s.add(cand=F.lower(py_strip_col(_c(src))))
    cand = s["cand"]
    s.add(v=F.regexp_replace(F.regexp_replace(cand, r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""))
    _split_stage(s, s["v"], "")
    _host_stage(s, "")
    s.add(
        bare=F.regexp_extract(cand, r"(?s)^([^#?]*)", 1),
    )
    bare = s["bare"]
    s.add(
        head=py_strip_col(F.regexp_extract(bare, r"(?s)^([^/]*)", 1)),
        bare_path=F.when(bare.contains("/"), F.concat(F.lit("/"), F.regexp_extract(bare, r"(?s)^[^/]*/(.*)$", 1))).otherwise(
            F.lit("/")
        ),
    )
    h = s["head"]
    s.add(h1=F.when(h.startswith("[") & h.endswith("]"), F.regexp_extract(h, r"(?s)^\[(.*)\]$", 1)).otherwise(h))
    h1 = s["h1"]
    one_colon = (F.length(h1) - F.length(F.regexp_replace(h1, ":", ""))) == 1
    s.add(h2=F.when(one_colon & h1.rlike(r"(?s):[0-9]+$"), F.regexp_extract(h1, r"(?s)^(.*):[0-9]+$", 1)).otherwise(h1))
    is_url = cand.contains("://")
    empty = cand == ""
    url_host = F.when(s["brackets_ok"], F.regexp_replace(F.lower(s["hostname"]), r"\.+$", "")).otherwise(F.lit(""))
    url_path = F.when(~s["brackets_ok"] | (s["path"] == ""), F.lit("/")).otherwise(s["path"])
    return s.finish(**{
        host_out: F.when(empty, F.lit("")).when(is_url, url_host).otherwise(F.regexp_replace(s["h2"], r"\.+$", "")),
        path_out: F.when(empty, F.lit("/")).when(is_url, url_path).otherwise(s["bare_path"]),
    })
