"""Preview ingest (pipeline A): newest history entries, deduplicated, filtered, encoded.

per-store rows -> newest-k per profile (W1) -> canonical URL, drop invalid (P1, F3)
-> one row per URL (A1) -> policy (F5) -> order (O1) -> max_items (O2)
-> encode without fallback (E4: a failed batch loses its rows, one error per batch)
-> vector preview (P9, P10, S7) and summary (A7)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_text
from ..operators import embed, history


def run_preview_ingest(
    snapshot: DataFrame,
    *,
    rules=(),
    limit_per_profile: int | None = None,
    max_items: int | None = None,
    encoder: embed.Encoder | None = None,
    model_name: str = "hash-64",
    dims: int = 64,
    batch_size: int = 8,
    preview_dims: int = 10,
    tags: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (previews, errors, summary)."""
    entries = history.preview_entries(snapshot, rules=rules, limit_per_profile=limit_per_profile, max_items=max_items)
    keyed = entries.withColumn("page_id", F.conv(F.substring(F.sha2("canonical_url", 256), 1, 15), 16, 10).cast("long"))
    to_encode = keyed.select("page_id", "title", F.col("canonical_url").alias("url"))
    encoded = embed.encode_pages(
        to_encode, model_name=model_name, dims=dims, encoder=encoder, batch_size=batch_size, fallback=False
    )
    ok = encoded.filter(F.col("embedding").isNotNull()).select("page_id", "embedding")
    previews = embed.preview(keyed.withColumn("embedding_input", embedding_text("title", "canonical_url")), ok,
                             dims=preview_dims, tags=tags)
    errors = encoded.filter(F.col("error").isNotNull()).join(keyed, "page_id").select(
        F.concat(
            F.lit("embedding failed for "), F.col("browser"), F.lit(":"), F.col("profile"), F.lit(" "),
            F.col("canonical_url"), F.lit(": "), F.col("error"),
        ).alias("error")
    )
    summary = history.snapshot_summary(snapshot, entries, limit_per_profile=limit_per_profile)
    return previews, errors, summary
