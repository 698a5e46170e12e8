"""Embedding jobs: candidate texts (P5/P6), batched encode with fallback (E2-E6),
content hashes (P7/E8), vector replacement (E7/J8) and previews (P9/S7).

The encoder is any callable ``(model_name, texts) -> list[list[float]]``. It
runs inside ``mapInPandas``: one encoder per task, Arrow batches in, and
every failure becomes a row (never a task failure).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import embedding_text, py_strip
from ..functions.urls import with_url_without_query
from ..session import ship_package

Encoder = Callable[[str, list[str]], list[list[float]]]

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("strategy", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


# The shrinking encoder inputs, as (characters of the title or None, of the URL, whether its query is left out).
CUTS = ((2**30, 2**30, False), (512, 2048, False), (256, 1024, True), (128, 512, True), (None, 512, True), (None, 512, False))


def with_candidate_texts(df: DataFrame, title: str = "title", url: str = "url", out: str = "candidates") -> DataFrame:
    """P5: shrinking encoder inputs, duplicates removed keeping the first (array<string>)."""
    staged = with_url_without_query(df.withColumn("_cu", py_strip(url)), "_cu", "_bare")
    t = py_strip(title)
    u = F.col("_cu")
    bare = F.col("_bare")

    def text(title_size: int | None, url_size: int, without_query: bool) -> Column:
        address = F.substring(bare if without_query else u, 1, url_size)
        return F.concat(F.lit("url: "), address) if title_size is None else embedding_text(F.substring(t, 1, title_size), address)

    cands = [text(*cut) for cut in CUTS]
    return staged.withColumn(out, F.array_distinct(F.array(*cands))).drop("_cu", "_bare")


def candidate_texts(title: str, url: str, bare: str) -> list[str]:
    """The same texts for one page, built inside a task for the few pages that need them."""
    cut = [(None if t is None else title[:t], (bare if without else url)[:u]) for t, u, without in CUTS]
    return list(dict.fromkeys(f"url: {u}" if t is None else f"title: {t}\nurl: {u}" for t, u in cut))


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, attempt (1-based), text -- one row per distinct candidate."""
    return with_candidate_texts(pages).select("page_id", F.posexplode("candidates").alias("pos", "text")).select(
        "page_id", (F.col("pos") + 1).alias("attempt"), "text"
    )


def content_hash(title: str | Column = "title", url: str | Column = "url") -> Column:
    """sha256 hex of ``title + '\\n' + url``."""
    t = F.col(title) if isinstance(title, str) else title
    u = F.col(url) if isinstance(url, str) else url
    return F.sha2(F.concat(t, F.lit("\n"), u), 256)


def hash_changes(pages: DataFrame, embedded: DataFrame | None, model_id: int | Column) -> DataFrame:
    """Which pages need (re-)encoding: new, changed or unchanged content for a model."""
    p = pages.select("page_id", content_hash().alias("content_hash"))
    mid = model_id if isinstance(model_id, Column) else F.lit(int(model_id))
    if embedded is None:
        return p.withColumn("reason", F.lit("new")).withColumn("needs_embedding", F.lit(True))
    e = embedded.filter(F.col("model_id") == mid).select("page_id", F.col("content_hash").alias("old_hash"))
    j = p.join(e, "page_id", "left")
    reason = (
        F.when(F.col("old_hash").isNull(), F.lit("new"))
        .when(F.col("old_hash") != F.col("content_hash"), F.lit("changed"))
        .otherwise(F.lit("unchanged"))
    )
    return j.select("page_id", "content_hash", reason.alias("reason")).withColumn(
        "needs_embedding", F.col("reason") != F.lit("unchanged")
    )


# --- encoders -------------------------------------------------------------------------------

_TOKEN = re.compile(r"\w+", re.UNICODE)


def hashing_encoder(dims: int = 64) -> Encoder:
    """Deterministic feature-hashing encoder: signed token counts, L2-normalised."""

    def encode(_model: str, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dims), dtype=np.float64)
        for i, text in enumerate(texts):
            for tok in _TOKEN.findall(text.lower()):
                h = int.from_bytes(hashlib.blake2b(tok.encode("utf-8"), digest_size=8).digest(), "little")
                out[i, h % dims] += 1.0 if (h >> 63) & 1 else -1.0
        norms = np.linalg.norm(out, axis=1)
        norms[norms == 0] = 1.0
        return (out / norms[:, None]).tolist()

    return encode


def _valid(vec, dims: int) -> str | None:
    if vec is None:
        return "missing vector"
    try:
        values = [float(x) for x in vec]
    except (TypeError, ValueError):
        return "vector is not a list of numbers"
    if len(values) != dims:
        return f"dimension mismatch: got {len(values)} expected {dims}"
    if not all(math.isfinite(x) for x in values):
        return "non-finite value"
    return None


def _checked(encoder: Encoder, model: str, texts: list[str], dims: int) -> tuple[list | None, str | None, dict[int, str]]:
    """Call the encoder once: (vectors, why the whole call is unusable, what is wrong with single vectors)."""
    try:
        vectors = encoder(model, texts)
    except Exception as exc:  # encoder failures become rows
        return None, f"call:{exc}", {}
    have = 0 if vectors is None else len(vectors)
    if have != len(texts):
        return None, f"count:{have}/{len(texts)}", {}
    problems = ((i, _valid(v, dims)) for i, v in enumerate(vectors))
    return list(vectors), None, {i: f"vector:{p}" for i, p in problems if p}


def _first_usable(encoder: Encoder, model: str, texts: list[str], dims: int) -> tuple[list[float] | None, int | None, str]:
    """The candidate texts one by one until a vector is usable: (vector, its number from 1, the last reason)."""
    why = "no-candidate"
    for number, text in enumerate(texts, start=1):
        vectors, reason, wrong = _checked(encoder, model, [text], dims)
        why = reason or wrong.get(0)
        if why is None:
            return [float(x) for x in vectors[0]], number, ""
    return None, None, why


def _encoded(encoder: Encoder, model: str, texts: list[str], dims: int, bisect: bool) -> list[tuple[list[float] | None, str | None]]:
    """(vector, problem) of every text of one batch; a call that fails is made again on both halves, down to single texts."""
    vectors, reason, wrong = _checked(encoder, model, texts, dims)
    if reason and bisect and len(texts) > 1:
        half = len(texts) // 2
        return _encoded(encoder, model, texts[:half], dims, bisect) + _encoded(encoder, model, texts[half:], dims, bisect)
    problems = [reason or wrong.get(i) for i in range(len(texts))]
    return [(None if p else [float(x) for x in vectors[i]], p) for i, p in enumerate(problems)]


def batches_by_length(lengths: list[int], budget: int) -> list[list[int]]:
    """Positions in batches of similar length, shortest first, of at most ``budget`` after padding to the longest (one text at least)."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and (len(out[-1]) + 1) * max(1, lengths[i]) <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def encode_rows(
    ids: list, titles: list[str], urls: list[str], bares: list[str], *, encoder: Encoder, model: str, dims: int,
    batch_size: int = 8, fallback: bool = True, token_budget: int | None = None, bisect: bool = False,
) -> list[tuple]:
    """Rows of RESULT_SCHEMA for some pages (titles and URLs as stored, URLs without their query); see :func:`encode_pages`."""
    texts = [f"title: {t}\nurl: {u}" for t, u in zip(titles, urls)]
    if token_budget:
        chunks = batches_by_length([len(_TOKEN.findall(t)) for t in texts], int(token_budget))
    else:
        chunks = [list(range(at, min(at + batch_size, len(ids)))) for at in range(0, len(ids), batch_size)]
    rows = []
    for chunk in chunks:
        found = _encoded(encoder, model, [texts[i] for i in chunk], dims, bisect)
        lost = next((p for _, p in found if p), None)
        if not fallback and lost and not bisect:
            # preview behaviour: the batch is lost as one, with one error on its first row
            rows += [(ids[i], None, "batch", None, lost, lost if j == 0 else None) for j, i in enumerate(chunk)]
            continue
        for i, (vector, problem) in zip(chunk, found):
            if problem is None:
                rows.append((ids[i], vector, "batch", None, None, None))
            elif not fallback:
                rows.append((ids[i], None, "batch", None, problem, problem))
            else:
                tried = candidate_texts(_strip(titles[i]), _strip(urls[i]), bares[i])
                vector, attempt, why = _first_usable(encoder, model, tried, dims)
                error = f"page_id={ids[i]} {problem}; {why}" if vector is None else None
                rows.append((ids[i], vector, "fallback", attempt, problem, error))
    return rows


def _strip(text: str | None) -> str | None:
    return None if text is None else text.strip()


def encode_pages(
    pages: DataFrame,
    *,
    model_name: str,
    dims: int,
    encoder: Encoder | None = None,
    batch_size: int = 8,
    fallback: bool = True,
    workers: int | None = None,
    token_budget: int | None = None,
    bisect: bool = False,
) -> DataFrame:
    """Encode ``title: ..\nurl: ..`` for every page, in batches per task.

    A batch whose call fails, or returns the wrong count, falls back page by
    page through the candidate texts (``fallback=True``); a single vector of
    the wrong size falls back alone. With ``fallback=False`` a batch whose call
    fails or that holds any unusable vector is lost as a whole, with one error. ``workers`` bounds
    the number of concurrent tasks calling the encoder.

    ``token_budget`` forms batches of pages of similar length instead, each of at most so
    many tokens after padding. ``bisect`` splits a failed batch in halves
    until the page that fails is alone, so that the others keep batched calls; without
    ``fallback`` only that page is lost then.
    """
    enc = encoder or hashing_encoder(dims)
    size = max(1, int(batch_size))
    staged = with_url_without_query(pages.withColumn("_cu", py_strip("url")), "_cu", "_bare")
    src = staged.select("page_id", F.col("title").alias("_title"), F.col("url").alias("_url"), "_bare")
    if workers:
        src = src.repartition(int(workers))

    def run(batches):
        for pdf in batches:
            rows = encode_rows(
                *[pdf[c].tolist() for c in ("page_id", "_title", "_url", "_bare")], encoder=enc, model=model_name, dims=dims,
                batch_size=size, fallback=fallback, token_budget=token_budget, bisect=bisect,
            )
            yield pd.DataFrame(rows, columns=[f.name for f in RESULT_SCHEMA.fields])

    ship_package(pages.sparkSession)
    return src.mapInPandas(run, RESULT_SCHEMA)


def replace_vectors(existing: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Page vectors replaced by page_id (delete then insert)."""
    f = fresh.select("page_id", "embedding")
    if existing is None:
        return f
    return existing.select("page_id", "embedding").join(f.select("page_id"), "page_id", "left_anti").unionByName(f)


def persist(
    encoded: DataFrame,
    pages: DataFrame,
    model_id: int,
    updated_at_us: int,
    existing_meta: DataFrame | None = None,
    existing_vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Upsert (page_id, model_id, content_hash, updated_at_us) and replace the vectors."""
    ok = encoded.filter(F.col("embedding").isNotNull()).select("page_id", "embedding")
    meta = ok.join(pages.select("page_id", content_hash().alias("content_hash")), "page_id").select(
        "page_id",
        F.lit(int(model_id)).cast("long").alias("model_id"),
        "content_hash",
        F.lit(int(updated_at_us)).cast("long").alias("updated_at_us"),
    )
    if existing_meta is not None:
        meta = existing_meta.join(meta.select("page_id"), "page_id", "left_anti").unionByName(meta)
    return meta, replace_vectors(existing_vectors, ok)


def preview(entries: DataFrame, vectors: DataFrame, dims: int = 10, tags: list[str] | None = None) -> DataFrame:
    """Entry + first ``dims`` values (6 decimals) + constant tags (null when none)."""
    n = max(1, int(dims))
    head = F.slice("embedding", 1, n)
    tag_col = F.array(*[F.lit(t) for t in tags]) if tags else F.lit(None).cast("array<string>")
    return entries.join(vectors.select("page_id", "embedding"), "page_id").select(
        *[c for c in entries.columns],
        head.alias("vector_preview"),
        F.array_join(F.transform(head, lambda x: F.format_string("%.6f", x.cast("double"))), ", ").alias("preview_text"),
        tag_col.alias("llm_tags"),
    )
