"""Helpers of the operators: stored intermediate tables and Arrow buffers as numpy arrays."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never an earlier
    stage. The shuffle files of the finished query are removed with it.
    A step that names ``batch_bytes`` (:func:`in_arrow`) gets its batches cut by it meanwhile.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {CLEANUP: spark.conf.get(CLEANUP, "false"), BATCH_BYTES: spark.conf.get(BATCH_BYTES)}
    spark.conf.set(CLEANUP, "true")
    if df.__dict__.get("_batch_bytes"):
        spark.conf.set(BATCH_BYTES, str(df._batch_bytes))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder that :func:`stored` wrote ``df`` to; only once the tables made from it are stored themselves."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a worker process no longer needs back to the system; the process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def in_arrow(df: DataFrame, fn, schema: str, batch_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers.

    A step over the very rows of another one runs in the same Python process: a task holds one of them, not one for each step,
    and no rows go back to the JVM in between. Every task gives its memory back at its end, as the process lives on for other stages.
    ``batch_bytes``: where :func:`stored` writes the result, rows go to Python in batches of about so many bytes (one row at least).
    """
    rows, steps = df.__dict__.get("_in_arrow", (df, []))
    steps = [*steps, fn]

    def task(batches):
        for step in steps:
            batches = step(batches)
        try:
            yield from batches
        finally:
            release()

    ship_package(df.sparkSession)
    out = rows.mapInArrow(task, schema)
    out._in_arrow = rows, steps
    out._batch_bytes = batch_bytes
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[off[0] : off[-1]]
    return off - off[0], raw
