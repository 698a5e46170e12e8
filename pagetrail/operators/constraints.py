"""The history tables' constraints, declared once; the audit (I1, I4, I5) and the cascading purge (I2) are derived from them.

``SCHEMA`` lists, per table, its key, what must not be null, what is unique,
what its rows must satisfy and which columns refer to other tables.

* :func:`audit` gives one row per violated constraint and key. A table is
  scanned once per key: one grouped pass (with partial aggregation, so that a hot key
  is one row per task) counts duplicates, and the pass over the primary key carries the null and check counts as well. The
  grouped keys of a referenced table are stored and serve as the parent side of
  all references to it.
* :func:`gate` raises :class:`IntegrityError` for tables with violations.
* :func:`purge` removes rows and follows the references: CASCADE removes the
  rows that refer to removed ones, SET NULL empties the reference, RESTRICT
  refuses. A worklist of tables with newly removed keys runs until nothing is
  added. Tables that nothing refers to are filtered by their references directly,
  without a list of their removed keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .history import folder_tree

CASCADE, SET_NULL, RESTRICT = "cascade", "set null", "restrict"


class IntegrityError(RuntimeError):
    """Tables that violate a declared constraint."""


class RestrictError(RuntimeError):
    """Rows that cannot be removed because others refer to them."""


@dataclass(frozen=True)
class Reference:
    column: str
    table: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    key: str
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)  # name -> SQL condition; unknown passes
    references: tuple[Reference, ...] = ()


SCHEMA = {
    "source_profiles": Table("source_profile_id", ("browser", "profile_key"), (("profile_key",),)),
    "pages": Table("page_id", ("url", "host", "title", "first_seen_us", "last_seen_us", "normalization_version"), (("url",),)),
    "visits": Table(
        "visit_id",
        ("page_id", "visited_at_us", "title_snapshot", "source_profile_id", "source_visit_id"),
        (("source_profile_id", "source_visit_id"),),
        references=(Reference("page_id", "pages", CASCADE), Reference("source_profile_id", "source_profiles", CASCADE)),
    ),
    "bookmark_folders": Table(
        "folder_id", ("title", "position", "created_at_us", "updated_at_us"), references=(Reference("parent_folder_id", "bookmark_folders", CASCADE),)
    ),
    "bookmarks": Table(
        "bookmark_id",
        ("page_id", "status", "created_at_us", "updated_at_us"),
        references=(Reference("page_id", "pages", CASCADE), Reference("folder_id", "bookmark_folders", SET_NULL)),
    ),
    "embedding_models": Table(
        "model_id", ("model_name", "dimensions", "is_active"), (("model_name",),), {"dimensions > 0": "dimensions > 0"}
    ),
    "page_embeddings": Table(
        "page_id",
        ("model_id", "content_hash", "updated_at_us"),
        references=(Reference("page_id", "pages", CASCADE), Reference("model_id", "embedding_models", RESTRICT)),
    ),
    # beyond the declared foreign keys: search text and vectors belong to their page
    "page_text": Table("page_id", references=(Reference("page_id", "pages", CASCADE),)),
    "page_embedding_vec": Table("page_id", ("embedding",), references=(Reference("page_id", "pages", CASCADE),)),
}
ONE_ACTIVE = "exactly one active"
DIMENSIONS = "embedding has the dimensions of the active model"


def _key_text(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def _rows(table: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(table).alias("table"), "constraint", "key", F.col("n").cast("long").alias("n"))


def _grouped_key(name: str, spec: Table, df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per value of the primary key: number of rows, and of rows that break each null or check constraint."""
    broken = [F.count_if(~ok).alias(f"_broken{i}") for i, ok in enumerate(checks.values())]
    return df.groupBy(F.col(spec.key).alias("_key")).agg(F.count(F.lit(1)).alias("n"), *broken)


def _key_violations(name: str, spec: Table, grouped: DataFrame, checks: dict[str, Column]) -> DataFrame:
    one = lambda label, key, n: F.struct(F.lit(label).alias("constraint"), key.alias("key"), n.alias("n"))
    found = [
        F.when(F.col("_key").isNull(), one(f"{spec.key} not null", F.lit("*"), F.col("n"))),
        F.when(F.col("_key").isNotNull() & (F.col("n") > 1), one(f"{spec.key} unique", F.col("_key").cast("string"), F.col("n"))),
    ]
    found += [F.when(F.col(f"_broken{i}") > 0, one(label, F.lit("*"), F.col(f"_broken{i}"))) for i, label in enumerate(checks)]
    rows = grouped.select(F.inline(F.array_compact(F.array(*found))))
    return _rows(name, rows.groupBy("constraint", "key").agg(F.sum("n").alias("n")))


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """table, constraint, key ('*' for null and check constraints), n: the violations of ``tables`` (names of ``SCHEMA``).

    References to tables that are not given are not judged.
    """
    unknown = set(tables) - set(SCHEMA)
    if unknown or not tables:
        raise ValueError(f"tables to audit: some of {sorted(SCHEMA)}, not {sorted(unknown)}")
    models = tables.get("embedding_models")
    parents = {r.table for name in tables for r in SCHEMA[name].references} & set(tables)
    parts, keys = [], {}
    for name, df in tables.items():
        spec = SCHEMA[name]
        checks = {f"{c} not null": F.col(c).isNotNull() for c in spec.not_null if c != spec.key}
        checks |= {label: F.coalesce(F.expr(sql), F.lit(True)) for label, sql in spec.checks.items()}
        if name == "page_embedding_vec" and models is not None:
            dims = models.filter("is_active").select(F.max("dimensions")).scalar()
            checks[DIMENSIONS] = F.coalesce(F.size("embedding") == dims, F.lit(True))
        grouped = _grouped_key(name, spec, df, checks)
        if name in parents:
            keys[name] = grouped = stored(grouped, f"keys_{name}")
        parts.append(_key_violations(name, spec, grouped, checks))
        for columns in spec.unique:
            many = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            parts.append(_rows(name, many.select(F.lit(f"({', '.join(columns)}) unique").alias("constraint"), _key_text(columns).alias("key"), "n")))
    for name, df in tables.items():
        for ref in SCHEMA[name].references:
            if ref.table not in keys:
                continue
            if ref.column == SCHEMA[name].key and name in keys:
                used = keys[name].select(F.col("_key"), "n")
            else:
                used = df.groupBy(F.col(ref.column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
            lost = used.filter("_key is not null").join(keys[ref.table].select("_key"), "_key", "left_anti")
            parts.append(_rows(name, lost.select(F.lit(f"{ref.column} in {ref.table}").alias("constraint"), F.col("_key").cast("string").alias("key"), "n")))
    if models is not None:
        active = models.agg(F.count_if("is_active").alias("n")).filter("n <> 1")
        parts.append(_rows("embedding_models", active.select(F.lit(ONE_ACTIVE).alias("constraint"), F.lit("*").alias("key"), "n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gate(tables: dict[str, DataFrame], shown: int = 10) -> None:
    """Raise :class:`IntegrityError` naming some of the violations, if there are any."""
    found = audit(tables).limit(shown).collect()
    if found:
        raise IntegrityError("; ".join(f"{r['table']}: {r['constraint']}, key {r['key']}, {r['n']} rows" for r in found))


def _with_descendants(name: str, df: DataFrame, ref: Reference, removed: DataFrame) -> DataFrame:
    """Removed keys of a table that refers to itself, with all rows below them."""
    key = SCHEMA[name].key
    tree = folder_tree(df.select(F.col(key).alias("folder_id"), F.col(ref.column).alias("parent_folder_id")))
    below = tree.join(removed.select(F.col("_key").alias("ancestor_id")), "ancestor_id").select(F.col("folder_id").alias("_key"))
    return removed.unionByName(below).distinct()


def purge(tables: dict[str, DataFrame], doomed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` without the rows named by ``doomed`` (table -> DataFrame with its key column) and what depends on them.

    Every table of the result has an added boolean ``_nulled``: whether a reference of the row was emptied.
    """
    references = [(name, ref) for name in tables for ref in SCHEMA[name].references if ref.table in tables]
    referenced = {ref.table for _, ref in references}
    removed: dict[str, DataFrame] = {}
    waiting: list[tuple[str, DataFrame]] = []

    def add(name: str, keys: DataFrame) -> None:
        """Newly removed keys of a table (``_key``), closed over references to itself."""
        for child, ref in references:
            if child == name == ref.table and ref.on_delete == CASCADE:
                keys = _with_descendants(name, tables[name], ref, keys)
        keys = keys.filter("_key is not null").distinct()
        if name in removed:
            keys = keys.join(removed[name], "_key", "left_anti")
        keys = stored(keys, f"removed_{name}")
        if keys.isEmpty():
            return
        removed[name] = removed[name].unionByName(keys) if name in removed else keys
        waiting.append((name, keys))

    for name, keys in doomed.items():
        add(name, keys.select(F.col(SCHEMA[name].key).alias("_key")))
    while waiting:
        parent, keys = waiting.pop(0)
        for child, ref in references:
            if ref.table != parent or child == parent:
                continue
            hit = tables[child].join(keys, F.col(ref.column) == F.col("_key"), "left_semi")
            if ref.on_delete == RESTRICT:
                row = hit.select(ref.column).head()
                if row is not None:
                    raise RestrictError(f"{parent} {row[0]} is referred to by {child}.{ref.column}")
            elif ref.on_delete == CASCADE and child in referenced:
                add(child, hit.select(F.col(SCHEMA[child].key).alias("_key")))

    out = {}
    for name, df in tables.items():
        kept, nulled = df, F.lit(False)
        if name in removed:
            kept = kept.join(removed[name], F.col(SCHEMA[name].key) == F.col("_key"), "left_anti")
        for i, ref in enumerate(SCHEMA[name].references):
            if ref.table not in removed or ref.table == name:
                continue
            gone = removed[ref.table].withColumnRenamed("_key", f"_gone{i}")
            if ref.on_delete == CASCADE:
                kept = kept.join(gone, F.col(ref.column) == F.col(f"_gone{i}"), "left_anti")
            elif ref.on_delete == SET_NULL:
                kept = kept.join(gone, F.col(ref.column) == F.col(f"_gone{i}"), "left")
                nulled = nulled | F.col(f"_gone{i}").isNotNull()
                kept = kept.withColumn(ref.column, F.when(F.col(f"_gone{i}").isNull(), F.col(ref.column)))
        out[name] = kept.withColumn("_nulled", nulled).select(*df.columns, "_nulled")
    return out


def purge_counts(tables: dict[str, DataFrame], doomed: dict[str, DataFrame]) -> DataFrame:
    """table, rows_before, rows_after, rows_nulled of a purge."""
    after = purge(tables, doomed)
    parts = []
    for name, df in tables.items():
        left = after[name].agg(F.count(F.lit(1)).alias("rows_after"), F.count_if("_nulled").alias("rows_nulled"))
        before = df.select(F.count(F.lit(1))).scalar()
        parts.append(left.select(F.lit(name).alias("table"), before.alias("rows_before"), "rows_after", "rows_nulled"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
