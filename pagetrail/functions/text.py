"""Text Column expressions: title clean-up, embedding input text, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import PY_WHITESPACE_CLASS

UNTITLED = "(untitled)"

# Latin letters with diacritics and the base letter each folds to
# (one-to-one, position by position), used for keyword search tokens.
ACCENTED = "àáâãäåāăąçćčďèéêëēėęěìíîïīįłñńňòóôõöøōőùúûüūůűųýÿžźżšśşřŕťţğ"
FOLDED = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooouuuuuuuuyyzzzsssrrttg"

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col: str | Column) -> Column:
    """Strip the characters Python's str.strip() strips (Spark's trim only strips U+0020)."""
    return F.regexp_replace(_c(col), f"^[{PY_WHITESPACE_CLASS}]+|[{PY_WHITESPACE_CLASS}]+$", "")


def clean_title(col: str | Column) -> Column:
    """Stripped title; null or blank becomes the ``(untitled)`` placeholder."""
    t = py_strip(F.coalesce(_c(col), F.lit("")))
    return F.when(t == F.lit(""), F.lit(UNTITLED)).otherwise(t)


def embedding_text(title: str | Column, url: str | Column) -> Column:
    """Encoder input: ``title: {title}\\nurl: {url}``."""
    return F.concat(F.lit("title: "), _c(title), F.lit("\nurl: "), _c(url))


def fold(col: str | Column) -> Column:
    """Lower-case and fold Latin accents."""
    return F.translate(F.lower(_c(col)), ACCENTED, FOLDED)


def raw_tokens(col: str | Column) -> Column:
    """Folded text split on runs of non-alphanumerics; only the first and last item can be ''."""
    return F.split(fold(F.coalesce(_c(col), F.lit(""))), TOKEN_SPLIT)


def token_count(raw: Column) -> Column:
    """Number of non-empty items of a ``raw_tokens`` array, without a per-item lambda."""
    n = F.size(raw)
    lead = F.when(F.element_at(raw, 1) == F.lit(""), F.lit(1)).otherwise(F.lit(0))
    trail = F.when((n > 1) & (F.element_at(raw, -1) == F.lit("")), F.lit(1)).otherwise(F.lit(0))
    return n - lead - trail


def tokens(col: str | Column) -> Column:
    """Search tokens: folded text split on runs of non-alphanumerics, empties removed."""
    return F.filter(raw_tokens(col), lambda t: t != F.lit(""))
