"""Ready-made operations of a table, as transformations of its frame.  Counts are the only actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.snapshot import Index, Snapshot, Table


class CrudError(ValueError):
    pass


def insertable(t: Table) -> list[str]:
    return [c.name for c in t.columns if not (c.is_identity or c.is_row_version or c.is_computed)]


def updatable(t: Table) -> list[str]:
    return [c.name for c in t.columns if not (c.is_identity or c.is_row_version or c.is_computed or c.is_primary_key)]


def upsert_columns(t: Table) -> list[str]:
    return [c.name for c in t.columns if not (c.is_row_version or c.is_computed or c.is_identity and not c.is_primary_key)]


def _writable(t: Table) -> None:
    if t.is_view:
        raise CrudError(f"{t.name} is a view")


def _match(values: dict) -> Column:
    cond = F.lit(True)
    for k, v in values.items():
        cond = cond & (F.col(k) == F.lit(v))
    return cond


def _keyed(t: Table, key: dict) -> None:
    want = {c.name.lower() for c in t.key}
    if not want or {k.lower() for k in key} != want:
        raise CrudError(f"{t.name}: the key is {sorted(want)}")


def get_all(df: DataFrame, t: Table) -> DataFrame:
    return df.select(*[c.name for c in t.columns])


def get_by_id(df: DataFrame, t: Table, key: dict) -> DataFrame:
    _keyed(t, key)
    return df.where(_match(key)).limit(1)


def loaders(s: Snapshot, table: str, scope: str | None = None) -> dict[str, Callable]:
    """One lookup for each foreign-key column, but for a sole primary key and the scope column."""
    t = s.table(table)
    sole = t.key[0].name.lower() if len(t.key) == 1 else None
    out = {}
    for f in s.foreign_keys:
        if f.from_table.lower() == table.lower() and f.from_column.lower() not in (sole, (scope or "").lower()):
            out[f"get_by_{f.from_column.lower()}"] = lambda df, v, c=f.from_column: df.where(F.col(c) == F.lit(v))
    return out


def rows_frame(df: DataFrame, rows, columns: list[str]) -> DataFrame:
    """Dicts, Rows, dataclasses or a frame, in the types of ``df``."""
    if isinstance(rows, DataFrame):
        return rows.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns])
    plain = [r if isinstance(r, dict) else r.asDict() if hasattr(r, "asDict") else vars(r) for r in rows]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns])
    return df.sparkSession.createDataFrame([tuple(r.get(c) for c in columns) for r in plain], schema)


def guard(rows: list[dict], t: Table) -> None:
    """Nulls and lengths of values that are to be written, before anything runs."""
    for r in rows:
        for c in t.columns:
            v = r.get(c.name)
            if v is None and c.name in r and not c.is_nullable and not c.is_identity:
                raise CrudError(f"{t.name}.{c.name} is null")
            if isinstance(v, (str, bytes)) and c.max_length and 0 < c.max_length < len(v):
                raise CrudError(f"{t.name}.{c.name}: {len(v)} is longer than {c.max_length}")


def insert(df: DataFrame, t: Table, rows, scope: dict | None = None) -> DataFrame:
    """``scope`` overwrites the scope column of every row."""
    _writable(t)
    if not isinstance(rows, DataFrame):
        guard(rows, t)
    new = rows_frame(df, rows, [c for c in df.columns])
    for k, v in (scope or {}).items():
        new = new.withColumn(k, F.lit(v).cast(df.schema[k].dataType))
    return df.unionByName(new)


def with_identity(rows: DataFrame, column: str, last: int | None, order: list[str]) -> DataFrame:
    """Ids from ``last`` + 1 in the order given; for row batches that one writer appends."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return rows.withColumn(column, (F.row_number().over(w) + (last or 0)).cast("long"))


def numbered(rows: DataFrame, column: str, last: int) -> DataFrame:
    """Ids from ``last`` + 1 in the order in which the rows stand.

    Partitions are counted, and each begins where the ones before it end, so no task holds all rows."""
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    parts = sorted(placed.groupBy(F.shiftright("_place", 33).alias("p")).count().collect())  # a row a partition
    begins, at = {}, last + 1
    for p, n in parts:
        begins[p] = at
        at += n
    first = F.create_map(*[F.lit(x) for p, b in begins.items() for x in (p, b)]) if begins else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return placed.withColumn(column, F.element_at(first, F.shiftright("_place", 33)) + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place")


def update_where(df: DataFrame, cond: Column, values: dict) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return df.select(*[F.when(hit, (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if (v := values.get(c, df)) is not df else F.col(c) for c in df.columns])


def update(df: DataFrame, t: Table, key: dict, values: dict, scope: dict | None = None) -> tuple[DataFrame, Column]:
    """(new frame, condition of the rows changed); keys, identities and computed columns cannot be set."""
    _writable(t)
    _keyed(t, key)
    wrong = set(values) - set(updatable(t))
    if wrong:
        raise CrudError(f"{t.name}: {sorted(wrong)} cannot be set")
    guard([values], t)
    cond = _match(key | (scope or {}))
    return update_where(df, cond, values), cond


def update_from(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: columns of the matching row of ``other``, whose keys are unique."""
    side = other.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(side, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows for which the condition is null stay."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def delete(df: DataFrame, t: Table, key: dict, scope: dict | None = None) -> tuple[DataFrame, Column]:
    _writable(t)
    _keyed(t, key)
    cond = _match(key | (scope or {}))
    return delete_where(df, cond), cond


def upsert_key(t: Table) -> list[str]:
    """The primary key unless all identity; else the first whole unique index without identities."""
    key = t.key
    if key and not all(c.is_identity for c in key):
        return [c.name for c in key]
    for i in t.indexes:
        cols = [t.column(c) for c in i.columns]
        if i.is_unique and not i.has_prefix_keys and not i.has_expression_keys and all(cols) and not any(c.is_identity for c in cols):
            return list(i.columns)
    raise CrudError(f"{t.name} has no key to upsert by")


def competing_unique(t: Table) -> list[Index]:
    """Other unique indexes that an upserted row can collide with."""
    key = {c.lower() for c in upsert_key(t)}
    return [i for i in t.indexes if i.is_unique and {c.lower() for c in i.columns} != key]


def upsert(df: DataFrame, t: Table, rows, on_match: str = "update", key: list[str] | None = None) -> DataFrame:
    """Of rows with one key the last wins, in a frame the one that stands last; null keys never match."""
    _writable(t)
    key = key or upsert_key(t)
    if isinstance(rows, DataFrame):
        whole = " AND ".join(f"`{k}` IS NOT NULL" for k in key)
        rest = [c for c in df.columns if c not in key]
        placed = rows_frame(df, rows, df.columns).withColumn("_place", F.monotonically_increasing_id())
        last = placed.where(whole).groupBy(*key).agg(F.max_by(F.struct(*rest, F.lit(0).alias("_v")), "_place").alias("_last"))
        new = last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns).unionByName(placed.where(f"NOT ({whole})").drop("_place"))
    else:
        guard(rows, t)
        plain = [r if isinstance(r, dict) else r.asDict() for r in rows]
        last = {tuple(r.get(k) for k in key) if all(r.get(k) is not None for k in key) else ("", n): r for n, r in enumerate(plain)}
        new = rows_frame(df, list(last.values()), df.columns)
    if on_match == "nothing":
        return df.unionByName(new.join(df.select(*key), key, "left_anti").select(*df.columns))
    return df.join(new.select(*key), key, "left_anti").select(*df.columns).unionByName(new)


def versioned_update(df: DataFrame, key: dict, values: dict, column: str, seen: int) -> tuple[DataFrame, int]:
    """Update only the version seen; 0 rows changed means it was stale."""
    cond = _match(key) & (F.col(column) == F.lit(seen))
    return update_where(df, cond, values | {column: F.col(column) + 1}), df.where(cond).count()


def scoped(df: DataFrame, scope: dict) -> DataFrame:
    return df.where(_match(scope))


def eligible(s: Snapshot) -> dict[str, list[str]]:
    """Operations that each table gets; views and tables without a key are read only."""
    out = {}
    names = [t.name.lower() for t in s.tables]
    for t in s.tables:
        if names.count(t.name.lower()) > 1 or not t.name.split(".")[-1].replace("_", "a").isalnum() or t.name[:1].isdigit():
            continue
        ops = ["get_all", *loaders(s, t.name)]
        if t.key:
            ops.append("get_by_id")
        if not t.is_view:
            ops += ["insert", "bulk_insert"]
            if t.key:
                ops += ["delete"] + (["update"] if updatable(t) else [])
            try:
                upsert_key(t)
                ops.append("upsert")
            except CrudError:
                pass
        out[t.name] = ops
    return out
