"""A training-corpus pipeline over ``documents``: every stage is written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import bpe, decontaminate, lang_id, minhash_join, suffix_dedup
from pagetrail.llm.queries import tokenizer_path
from pagetrail.llm.shared import stored, table

BATCH_ROWS = 1_000  # documents that go to a Python worker together; whole texts need not fit many times into it
LEAST_MARGIN = 0.01  # by which the predicted language must be ahead of the next one


def _in_small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows for the session's Python stages: JVM and worker hold a batch each, several times while they convert it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose whole text is in one of the learned languages; text without letters, or with no language ahead, goes.

    Where nothing is labelled there is nothing to learn from, and all documents stay.
    """
    _in_small_batches(spark)
    network = lang_id.fit(docs)
    if network is None:
        return docs
    judged = lang_id.predict(docs, network)
    return judged.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("margin") >= LEAST_MARGIN)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each class of near duplicates (shingles of five words, similarity 0.8)."""
    _in_small_batches(spark)
    return minhash_join.deduplicated(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out byte strings of 100 and more that stand earlier in the corpus."""
    _in_small_batches(spark)
    return suffix_dedup.without_repeats(docs, threshold=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    _in_small_batches(spark)
    path = tokenizer_path()
    both = bpe.decoded(bpe.encoded(docs, path), path)
    return both.withColumn("exact", F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

# Training, hashing and tokenising are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
