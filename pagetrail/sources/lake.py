"""Partitioned tables that are committed together.

A lake is a folder of tables. The rows of a table lie in partitions of one
integer column (visits by day, pages by hash bucket); a partition is a list of
folders. A commit writes new folders only, for the partitions that it touches,
and then publishes a manifest: one small JSON file that names, for every table
and partition, the folders that hold it. Readers go by the newest manifest, so

* all tables of a commit change at once: what fails before the manifest is
  written leaves the state before, whole and readable;
* untouched partitions are neither read nor written;
* older versions stay readable until :meth:`Lake.vacuum`.

``replace`` rewrites the partitions it is given, ``append`` adds a folder to
them; a partition of more than ``MAX_FOLDERS`` folders is written anew as one.
Marks in the manifest name what a commit was made from (a stream and its epoch),
so work that is replayed after a failure can be recognised. One writer at a time
is expected; a second one that publishes the same version is refused.

The manifest has one entry per partition, not per row or file. Layout:
``<base>/manifests/v=<n>.json`` and
``<base>/data/<table>/commit=<n>-<attempt>/<column>=<value>/*.parquet``.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_FOLDERS = 16


class Conflict(RuntimeError):
    """Another writer has published the version that this commit was to become."""


class _Files:
    """The few file system calls a manifest needs, through Spark's Hadoop API (any store that Spark reads)."""

    def __init__(self, spark: SparkSession, base: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.hadoop.Path(name)

    def names(self, pattern: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.globStatus(self.path(pattern)) or []]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Lake:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self.files = _Files(spark, self.base)

    # ---- versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        found = (re.fullmatch(r"v=(\d+)\.json", n) for n in self.files.names(f"{self.base}/manifests/v=*.json"))
        return sorted(int(m.group(1)) for m in found if m)

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one for a new lake."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "marks": {}, "settings": {}, "tables": {}}
        return json.loads(self.files.read(f"{self.base}/manifests/v={version:08d}.json"))

    def tables_at(self, version: int | None = None) -> list[str]:
        return sorted(self.manifest(version)["tables"])

    # ---- reading -------------------------------------------------------------------------------

    def parts(self, table: str, version: int | None = None) -> list[int]:
        return sorted(int(p) for p in self.manifest(version)["tables"].get(table, {}).get("parts", {}))

    def read(self, table: str, parts: list[int] | None = None, version: int | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """A table, or some of its partitions; None where the lake holds nothing of them."""
        return self._frame(self.manifest(version), table, parts, columns)

    def _frame(self, manifest: dict, table: str, parts: list[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
        entry = manifest["tables"].get(table)
        if entry is None:
            return None
        held = entry["parts"]
        wanted = sorted(held) if parts is None else [str(p) for p in parts if str(p) in held]
        paths = [f"{self.base}/data/{table}/{folder}/{entry['column']}={p}" for p in wanted for folder in held[p]]
        if not paths:
            return None
        schema = StructType.fromJson(json.loads(entry["schema"]))
        df = self.spark.read.schema(schema).option("basePath", f"{self.base}/data/{table}").parquet(*paths)
        return df.select(*(columns or schema.fieldNames()))

    # ---- writing -------------------------------------------------------------------------------

    def begin(self) -> Commit:
        return Commit(self)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests older than the newest ``keep``, and folders that no kept manifest names; returns these folders."""
        versions = self.versions()
        newest = versions[-1] if versions else 0
        live = {
            (table, folder)
            for v in versions[-keep:]
            for table, entry in self.manifest(v)["tables"].items()
            for folders in entry["parts"].values()
            for folder in folders
        }
        gone = []
        for table in self.files.names(f"{self.base}/data/*"):
            for folder in self.files.names(f"{self.base}/data/{table}/commit=*"):
                number = int(folder.removeprefix("commit=").split("-")[0])
                if (table, folder) not in live and number <= newest:  # a later one may be at work
                    self.files.delete(f"{self.base}/data/{table}/{folder}")
                    gone.append(f"{table}/{folder}")
        for v in versions[:-keep]:
            self.files.delete(f"{self.base}/manifests/v={v:08d}.json")
        return gone


class Commit:
    """New folders of any number of tables, and the manifest that makes them visible together."""

    def __init__(self, lake: Lake):
        self.lake = lake
        self.manifest = lake.manifest()
        self.version = self.manifest["version"] + 1
        self.manifest["version"] = self.version
        self.attempt = uuid.uuid4().hex[:12]
        self.read_parts: dict[str, list[int]] = {}
        self.written_parts: dict[str, list[int]] = {}

    @property
    def marks(self) -> dict[str, int]:
        return self.manifest["marks"]

    def setting(self, name: str, default: int) -> int:
        """A number fixed when the lake is made, such as the number of buckets."""
        return self.manifest["settings"].setdefault(name, default)

    def read(self, table: str, parts: list[int] | None = None, columns: list[str] | None = None) -> DataFrame | None:
        """As of this commit so far; remembers which partitions were asked for."""
        held = self.manifest["tables"].get(table, {}).get("parts", {})
        self.read_parts[table] = sorted(int(p) for p in held if parts is None or int(p) in set(parts))
        return self.lake._frame(self.manifest, table, parts, columns)

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written once below the lake and reread: what a commit reads several times. Removed on publishing."""
        path = f"{self.lake.base}/staging/{self.version:08d}-{self.attempt}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.lake.spark.read.schema(df.schema).parquet(path)

    def _write(self, table: str, df: DataFrame, column: str, sort: tuple[str, ...]) -> tuple[str, list[int], str]:
        folder = f"commit={self.version:08d}-{self.attempt}-{uuid.uuid4().hex[:8]}"
        path = f"{self.lake.base}/data/{table}/{folder}"
        # rebalancing gathers a partition in few files, and splits one that holds much of the data
        df.hint("rebalance", column).sortWithinPartitions(column, *sort).write.partitionBy(column).parquet(path)
        parts = [int(n.split("=", 1)[1]) for n in self.lake.files.names(f"{path}/{column}=*")]
        schema = StructType([df.schema[c] for c in df.columns])
        return folder, sorted(parts), schema.json()

    def _entry(self, table: str, column: str, schema: str) -> dict:
        entry = self.manifest["tables"].setdefault(table, {"column": column, "schema": schema, "parts": {}})
        if entry["column"] != column or StructType.fromJson(json.loads(entry["schema"])).fieldNames() != StructType.fromJson(json.loads(schema)).fieldNames():
            raise ValueError(f"{table}: columns differ from those of the lake")
        return entry

    def replace(self, table: str, df: DataFrame, column: str, parts: list[int] | None = None, sort: tuple[str, ...] = ()) -> list[int]:
        """Rows of ``df`` become the whole content of the partitions ``parts`` (all of the table by default); returns those written."""
        folder, written, schema = self._write(table, df, column, sort)
        entry = self._entry(table, column, schema)
        stray = set(written) - set(written if parts is None else parts)
        if stray:
            raise ValueError(f"{table}: rows outside the replaced partitions: {sorted(stray)[:5]}")
        for p in list(entry["parts"]) if parts is None else map(str, parts):
            entry["parts"].pop(p, None)
        for p in written:
            entry["parts"][str(p)] = [folder]
        self.written_parts[table] = sorted(set(self.written_parts.get(table, [])) | set(written))
        return written

    def append(self, table: str, df: DataFrame, column: str, sort: tuple[str, ...] = ()) -> list[int]:
        """Add rows; partitions that have become long lists of folders are written anew."""
        folder, written, schema = self._write(table, df, column, sort)
        entry = self._entry(table, column, schema)
        for p in map(str, written):
            entry["parts"][p] = entry["parts"].get(p, []) + [folder]
        long = [p for p in written if len(entry["parts"][str(p)]) > MAX_FOLDERS]
        if long:
            self.replace(table, self.lake._frame(self.manifest, table, long), column, long, sort)
        self.written_parts[table] = sorted(set(self.written_parts.get(table, [])) | set(written))
        return written

    def appended(self, table: str) -> DataFrame | None:
        """The rows of the folders that this commit has written for ``table``."""
        mine = f"commit={self.version:08d}-{self.attempt}-"
        entry = self.manifest["tables"].get(table)
        if entry is None:
            return None
        own = {p: [f for f in folders if f.startswith(mine)] for p, folders in entry["parts"].items()}
        only = {"tables": {table: entry | {"parts": {p: f for p, f in own.items() if f}}}}
        return self.lake._frame(only, table)

    def publish(self, marks: dict[str, int] | None = None) -> int:
        """Make the commit the newest version."""
        self.manifest["marks"].update(marks or {})
        files, base = self.lake.files, self.lake.base
        target = f"{base}/manifests/v={self.version:08d}.json"
        draft = f"{base}/manifests/draft-{self.attempt}.json"
        files.write(draft, json.dumps(self.manifest, sort_keys=True))
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft)
            raise Conflict(f"version {self.version} exists already")
        for name in files.names(f"{base}/staging/{self.version:08d}-{self.attempt}-*"):
            files.delete(f"{base}/staging/{name}")
        return self.version


def hash_bucket(id_column: str, buckets: int):
    """Bucket of an id that is a hash itself."""
    return F.pmod(F.col(id_column), F.lit(buckets)).cast("int")
