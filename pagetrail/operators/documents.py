"""Search documents (E1) and their keyword postings.

A search document is (page_id, title, url, bookmark_text) for every touched
page, where bookmark_text joins the trimmed ``title_override + ' ' + notes``
of the page's live bookmarks with single spaces (ordered by bookmark_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import raw_tokens, token_count
from .history import live_bookmarks


def bookmark_texts(bookmarks: DataFrame) -> DataFrame:
    """A3: page_id, bookmark_text over live bookmarks.

    The per-page concatenation is bounded by the bookmarks one user keeps for
    one page; the keyword index never needs it (see ``postings``).
    """
    text = F.trim(F.concat(F.coalesce("title_override", F.lit("")), F.lit(" "), F.coalesce("notes", F.lit(""))))
    b = live_bookmarks(bookmarks).select("page_id", "bookmark_id", text.alias("t"))
    return b.groupBy("page_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("bookmark_id", "t"))), lambda s: s["t"]), " "
        ).alias("bookmark_text")
    )


def search_documents(pages: DataFrame, bookmarks: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """One document per touched page (J6 semi-join, J4 left join on pre-aggregated bookmarks)."""
    p = pages.select("page_id", "title", "url")
    if touched is not None:
        p = p.join(touched.select("page_id").distinct(), "page_id", "left_semi")
    return p.join(bookmark_texts(bookmarks), "page_id", "left").select(
        "page_id", "title", "url", F.coalesce("bookmark_text", F.lit("")).alias("bookmark_text")
    )


def replace_documents(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Replace documents by page_id (insert-or-replace)."""
    if existing is None:
        return fresh
    return existing.join(fresh.select("page_id"), "page_id", "left_anti").unionByName(fresh)


def doc_tokens(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """doc_id, tokens (raw split of every field, field weight 1 each; may hold ''), doc_len.

    Consumers explode ``tokens`` and drop '' -- cheaper than a per-token lambda.
    """
    raws = [f"_raw{i}" for i in range(len(text_cols))]
    t = docs.select(F.col(id_col).alias("doc_id"), *[raw_tokens(c).alias(r) for c, r in zip(text_cols, raws)])
    toks = F.concat(*[F.col(r) for r in raws]) if len(raws) > 1 else F.col(raws[0])
    length = token_count(F.col(raws[0]))
    for r in raws[1:]:
        length = length + token_count(F.col(r))
    return t.select("doc_id", toks.alias("tokens"), length.alias("doc_len"))


def postings(docs: DataFrame, id_col: str = "page_id", text_cols: list[str] | None = None) -> DataFrame:
    """Keyword index: (term, doc_id, tf) with partial aggregation before the shuffle."""
    cols = text_cols or ["title", "url", "bookmark_text"]
    t = doc_tokens(docs, id_col, cols)
    terms = t.select("doc_id", F.explode("tokens").alias("term")).filter(F.col("term") != F.lit(""))
    return terms.groupBy("term", "doc_id").agg(
        F.count(F.lit(1)).alias("tf")
    )
