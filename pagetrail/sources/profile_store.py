"""Browser profile stores (``<root>/<profile>/places.sqlite``) as a Spark data source.

Stores are listed once, on the driver, with Spark's file system API (S1); the
list travels to the scans as an option and is a table of its own, so that empty
and unreadable stores count as profiles too. Every store becomes one input
partition (S2/S3 scans run inside the task, read-only) and arrives as Arrow
batches. A store that cannot be read yields a single ``_error`` row and no data
(S4): every row is read and converted once before the first batch is emitted, one
batch at a time. SQLite needs a file path, so the stores themselves must be mounted on the executors.

The same stores are also a streaming source of visits (``STREAM_FORMAT``, T1).
Its offset is the last visit id of each store; a micro-batch holds the visits
above the offset, joined to their places inside the store, in partitions of
``SPLIT_IDS`` ids. A store whose ids have fallen below its offset was made anew
and is read from its start. A store that cannot be opened keeps its offset and
does not hold up the others. Spark plans the stream on the driver, which must see the stores as well.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType, IntegerType

FORMAT = "pagetrail.places"
STREAM_FORMAT = "pagetrail.visit_stream"

_STORE_FIELDS = [
    StructField("browser", StringType()),
    StructField("profile", StringType()),
    StructField("browser_rank", IntegerType()),
    StructField("store_path", StringType()),
]
PLACES_SCHEMA = StructType(
    _STORE_FIELDS
    + [
        StructField("place_id", LongType()),
        StructField("url", StringType()),
        StructField("title", StringType()),
        StructField("last_visit_date", LongType()),
        StructField("_error", StringType()),
    ]
)
VISITS_SCHEMA = StructType(
    _STORE_FIELDS
    + [
        StructField("visit_id", LongType()),
        StructField("place_id", LongType()),
        StructField("visit_date", LongType()),
        StructField("_error", StringType()),
    ]
)
# what ``ingest.annotate_visits`` takes
VISIT_STREAM_SCHEMA = StructType(
    _STORE_FIELDS
    + [
        StructField("source_visit_id", LongType()),
        StructField("raw_url", StringType()),
        StructField("raw_title", StringType()),
        StructField("visited_at_us", LongType()),
    ]
)

# The tables of a store and the columns read from them.
_TABLES = {
    "places": ("moz_places", ("id", "url", "title", "last_visit_date"), PLACES_SCHEMA),
    "visits": ("moz_historyvisits", ("id", "place_id", "visit_date"), VISITS_SCHEMA),
}
OPTIONAL = {"last_visit_date"}  # read as null where an old store lacks the column
BATCH_ROWS = 50_000
SPLIT_IDS = 1_000_000


def _open(path: str):
    import sqlite3

    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True, timeout=1.0))


def discover(spark: SparkSession, roots: list[tuple[str, str]]) -> list[tuple[str, str, int, str]]:
    """(browser, profile, browser_rank, store path) of the stores one level below each root, by rank and path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = []
    for rank, (browser, root) in enumerate(roots):
        pattern = hadoop.Path(os.path.expanduser(root), "*/places.sqlite")
        statuses = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        for status in statuses:
            if status.isFile():
                where = status.getPath()
                found.append((browser, where.getParent().getName(), rank, os.path.realpath(where.toUri().getPath())))
    return sorted(found, key=lambda s: s[2:])


def stores_table(spark: SparkSession, stores: list[tuple[str, str, int, str]]) -> DataFrame:
    """The listed stores as a table (browser, profile, browser_rank, store_path)."""
    return spark.createDataFrame(stores, StructType(_STORE_FIELDS))


class _Store(InputPartition):
    def __init__(self, store):
        super().__init__(tuple(store))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.stores = json.loads(options.get("stores", "[]"))
        self.table = table

    def partitions(self):
        return [_Store(s) for s in self.stores]

    def read(self, partition: _Store):
        import sqlite3

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        name, columns, schema = _TABLES[self.table]
        target = to_arrow_schema(schema)
        store = partition.value

        def batch(rows, error=None):
            n = 1 if error else len(rows)
            values = list(zip(*rows)) if rows else [(None,) * n] * len(columns)
            filled = [(v,) * n for v in store] + values + [(error,) * n]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(filled, target)], schema=target)

        def batches(conn):
            present = {c[1] for c in conn.execute(f"PRAGMA table_info({name})")}
            wanted = ["NULL" if c in OPTIONAL - present else c for c in columns]
            cursor = conn.execute(f"SELECT {', '.join(wanted)} FROM {name}")
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield batch(rows)

        try:
            with _open(store[3]) as conn:
                for _ in batches(conn):  # what fails, fails here, before any row has left
                    pass
                yield from batches(conn)
        except (sqlite3.Error, pa.ArrowException, TypeError) as exc:
            yield batch([], f"{store[0]}:{store[1]} ({os.path.basename(store[3])}) -> {exc}")


class _Range(InputPartition):
    """Visits of one store with ids in (after, last]."""

    def __init__(self, store, after: int, last: int):
        super().__init__((tuple(store), after, last))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.roots = json.loads(options.get("roots", "[]"))
        self.seen: dict[str, int] = {}

    def _stores(self) -> dict[str, tuple[str, str, int, str]]:
        """Path -> (browser, profile, browser_rank, path) of the stores there now; without Spark, which this process does not have."""
        found = {}
        for rank, (browser, root) in enumerate(self.roots):
            for path in sorted(map(os.path.realpath, glob.glob(os.path.join(glob.escape(os.path.expanduser(root)), "*", "places.sqlite")))):
                if os.path.isfile(path):
                    found[path] = (browser, os.path.basename(os.path.dirname(path)), rank, path)
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        import sqlite3

        for path in self._stores():
            try:
                with _open(path) as conn:
                    self.seen[path] = conn.execute("SELECT coalesce(max(id), 0) FROM moz_historyvisits").fetchone()[0]
            except sqlite3.Error:
                continue  # keeps its offset until it can be read
        return dict(sorted(self.seen.items()))

    def partitions(self, start: dict, end: dict):
        self.seen = {**end, **self.seen}  # a restarted stream knows the offsets of stores that it cannot open now
        stores = self._stores()
        out = []
        for path, last in end.items():
            after = start.get(path, 0)
            if after > last:
                after = 0
            if path in stores:
                out += [_Range(stores[path], lo, min(lo + SPLIT_IDS, last)) for lo in range(after, last, SPLIT_IDS)]
        return out

    def read(self, partition: _Range):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        store, after, last = partition.value
        target = to_arrow_schema(VISIT_STREAM_SCHEMA)
        sql = (
            "SELECT v.id, p.url, coalesce(p.title, ''), coalesce(v.visit_date, 0) FROM moz_historyvisits v "
            "JOIN moz_places p ON p.id = v.place_id WHERE v.id > ? AND v.id <= ? ORDER BY v.id"
        )
        with _open(store[3]) as conn:
            cursor = conn.execute(sql, (after, last))
            while rows := cursor.fetchmany(BATCH_ROWS):
                filled = [(v,) * len(rows) for v in store] + list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(filled, target)], schema=target)


class VisitStreamSource(DataSource):
    """``spark.readStream.format("pagetrail.visit_stream").option("roots", json.dumps([(browser, folder), ...]))``."""

    @classmethod
    def name(cls) -> str:
        return STREAM_FORMAT

    def schema(self):
        return VISIT_STREAM_SCHEMA

    def streamReader(self, schema):
        return _StreamReader(self.options)


class ProfileStoreSource(DataSource):
    """``spark.read.format("pagetrail.places").option("stores", json.dumps(discover(...))).option("table", "places")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return PLACES_SCHEMA if self.options.get("table", "places") == "places" else VISITS_SCHEMA

    def reader(self, schema):
        return _Reader(self.options, self.options.get("table", "places"))


def register(spark: SparkSession) -> None:
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(ProfileStoreSource)
    spark.dataSource.register(VisitStreamSource)


def read_stores(
    spark: SparkSession, roots: list[tuple[str, str]], stores: list[tuple[str, str, int, str]] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, visits, errors) for the given ``[(browser, root), ...]`` in processing order, or of ``stores`` listed before."""
    register(spark)
    spec = json.dumps(discover(spark, roots) if stores is None else stores)
    places = spark.read.format(FORMAT).option("stores", spec).option("table", "places").load()
    visits = spark.read.format(FORMAT).option("stores", spec).option("table", "visits").load()
    errors = (
        places.filter(F.col("_error").isNotNull())
        .select("browser", "profile", "_error")
        .unionByName(visits.filter(F.col("_error").isNotNull()).select("browser", "profile", "_error"))
        .distinct()
        .withColumnRenamed("_error", "error")
    )
    return places.filter(F.col("_error").isNull()).drop("_error"), visits.filter(F.col("_error").isNull()).drop("_error"), errors


def select_browsers(configured: list[str] | None, override: list[str] | None = None, supported=("zen", "firefox")) -> list[str]:
    """override list if given, else configured; unsupported names dropped; none left -> both."""
    chosen = [b for b in (override if override is not None else (configured or [])) if b in supported]
    return chosen or ["zen", "firefox"]
