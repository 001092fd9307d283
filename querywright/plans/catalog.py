"""A folder of ``.sql`` files as typed callables that return DataFrames, one row, or a lazy iterator."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..functions.types import spark_type
from ..sources.snapshot import Snapshot
from ..streaming.rows import lazy_rows
from .directives import Directives, split_top
from .directives import parse as parse_directives
from .model import Statement
from .model import parse as parse_sql
from .rewrite import rewrite

if TYPE_CHECKING:
    from ..operators.statements import Change

#: Beyond so many values a list parameter becomes a table to semi-join, not literals in the plan.
LITERALS = 1000


class ShapeError(TypeError):
    pass


class ParameterError(TypeError):
    pass


def entity_and_method(path: str, root: str) -> tuple[str, str]:
    """``root/[tables|views/]Entity/.../Method.sql``; files at the root belong to Queries."""
    parts = Path(path).relative_to(root).parts
    folders = [p for p in parts[:-1] if p.lower() not in ("tables", "views")]
    return (folders[0] if folders else "Queries", Path(parts[-1]).stem)


def scopes_of(s: Statement, snapshot: Snapshot | None) -> dict[str, dict[str, object]]:
    """Alias -> {column in lower case: Column or None} of the tables a statement reads."""
    out: dict[str, dict[str, object]] = {}
    for r in s.tables:
        table = snapshot.table(r.name) if snapshot else None
        if r.name.lower() in s.ctes:
            names = s.cte_columns.get(r.name.lower()) or [i.name for i in s.ctes[r.name.lower()].items]
            out[r.alias.lower()] = {n.lower(): None for n in names if n}
        elif table:
            out[r.alias.lower()] = {c.name.lower(): c for c in table.columns}
    return out


def parameter_types(s: Statement, d: Directives, snapshot: Snapshot | None) -> dict[str, tuple[str, bool]]:
    """Name -> (database type, nullable): by @params, else the bound column, else a result column of that name."""
    out = dict(d.params)
    for inner in s.every():
        scope = scopes_of(inner, snapshot)
        for b in inner.bindings:
            if b.param in out or not b.column:
                continue
            alias, name = b.column
            owners = [scope[alias.lower()]] if alias and alias.lower() in scope else list(scope.values())
            found = [c[name.lower()] for c in owners if c.get(name.lower()) is not None]
            if len(found) == 1:
                out[b.param] = (found[0].db_type, found[0].is_nullable)
    for item in s.items:
        if item.column and item.name:
            for p in s.params:
                if p not in out and p.lower() == item.name.lower():
                    found = [c[item.column[1].lower()] for c in scopes_of(s, snapshot).values() if c.get(item.column[1].lower()) is not None]
                    if len(found) == 1:
                        out[p] = (found[0].db_type, found[0].is_nullable)
    return out


_PYTHON = {T.IntegerType: int, T.LongType: int, T.ShortType: int, T.StringType: str, T.BooleanType: bool, T.DoubleType: (int, float), T.FloatType: (int, float), T.DecimalType: (int, Decimal), T.DateType: (date, str), T.TimestampNTZType: (datetime, str), T.TimestampType: (datetime, str)}


@dataclass
class Query:
    name: str
    source: str
    dialect: str = "native"
    snapshot: Snapshot | None = None
    path: str = ""
    directives: Directives = field(init=False)
    statement: Statement = field(init=False)
    types: dict[str, tuple[str, bool]] = field(init=False)

    def __post_init__(self):
        self.directives, self.sql = parse_directives(self.source)
        self.statement = parse_sql(self.sql)
        self.types = parameter_types(self.statement, self.directives, self.snapshot)
        self._checked = False

    @property
    def spark_sql(self) -> str:
        quals = frozenset({"dbo", "public", "main"})
        return rewrite(self.sql, self.dialect, quals, self.kinds)

    @property
    def kinds(self) -> dict[str, str]:
        """ "whole" or "text" of the columns that have one kind in all tables of the statement."""
        found: dict[str, set] = {}
        for s in self.statement.every():
            for scope in scopes_of(s, self.snapshot).values():
                for name, c in scope.items():
                    t = spark_type(c.db_type, self.dialect) if c is not None else None
                    kind = "text" if isinstance(t, T.StringType) else "whole" if isinstance(t, T.IntegralType) else None
                    found.setdefault(name, set()).add(kind)
        return {n: k for n, (k, *more) in found.items() if k and not more}

    @property
    def writes(self) -> bool:
        return self.statement.kind in ("INSERT", "UPDATE", "DELETE")

    def change(self, spark: SparkSession, frame_of: Callable[[str], DataFrame], **args) -> Change:
        """What a writing statement makes of its table; nothing is committed.  ``frame_of(name)`` gives tables."""
        from ..operators.statements import Writer

        if not self.writes:
            raise ShapeError(f"{self.name} does not write")
        self._takes(args)
        target = self.statement.tables[0].name
        for s in self.statement.every():
            for r in s.tables:
                if r.name.lower() != target.lower() and r.name.lower() not in s.ctes:
                    frame_of(r.name).createOrReplaceTempView(r.name)
        find = self.snapshot.table if self.snapshot else lambda _: None
        return Writer(spark, self.sql, self.dialect, find, frame_of, {k: self._value(k, v) for k, v in args.items()}, self.kinds).run()

    def execute(self, store, **args) -> DataFrame | int | list[int]:
        """Run a writing statement on a TableStore: the RETURNING rows, else the new ids of ``@identity``, else the rows changed."""
        return store.execute(self, **args)

    def _takes(self, args: dict) -> None:
        missing = [p for p in self.statement.params if p not in args]
        if missing or set(args) - set(self.statement.params):
            raise ParameterError(f"{self.name}: takes {self.statement.params}, got {sorted(args)}")

    def _value(self, name: str, value):
        kind = self.types.get(name)
        t = spark_type(kind[0], self.dialect) if kind else None
        if t is None or value is None:
            return value
        want = _PYTHON.get(type(t))
        if want and not isinstance(value, want) or isinstance(value, bool) and not isinstance(t, T.BooleanType):
            raise ParameterError(f"{self.name}: @{name} is {kind[0]}, not {type(value).__name__}")
        if isinstance(t, T.DecimalType):
            return Decimal(value)
        if isinstance(value, str) and isinstance(t, T.DateType):
            return date.fromisoformat(value)
        if isinstance(value, str) and isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            return datetime.fromisoformat(value)
        return float(value) if isinstance(t, (T.DoubleType, T.FloatType)) else value

    def __call__(self, spark: SparkSession, **args) -> DataFrame:
        """The result, not yet computed.  Empty lists give no rows without running anything."""
        if self.writes:
            raise ShapeError(f"{self.name} writes: use execute or change")
        self._takes(args)
        text, bound, empty = self.spark_sql, {}, False
        for name, value in args.items():
            if name in self.directives.each:
                value = list(value)
                empty |= not value
                value = [self._value(name, v) for v in value]
                if len(value) > LITERALS:
                    view = f"__each_{re.sub(r'\W', '_', self.name)}_{name}"
                    kind = self.types.get(name)
                    t = spark_type(kind[0], self.dialect) if kind else T.LongType()
                    spark.createDataFrame([(v,) for v in value], T.StructType([T.StructField("value", t)])).createOrReplaceTempView(view)
                    text = re.sub(rf"\(\s*:{name}\s*\)|:{name}\b", f"(SELECT value FROM {view})", text)
                else:
                    marks = [f"{name}__{k}" for k in range(len(value))] or [f"{name}__0"]
                    bound |= dict(zip(marks, value or [None], strict=True))
                    inner = ", ".join(":" + m for m in marks)
                    text = re.sub(rf"\(\s*:{name}\s*\)|:{name}\b", f"({inner})", text)
            else:
                bound[name] = self._value(name, value)
        df = spark.sql(text, args=bound)
        self.check_shape(df.schema)
        if empty:
            return spark.createDataFrame([], df.schema)
        return df.limit(1) if self.directives.first else df

    def first(self, spark: SparkSession, **args) -> Row | None:
        return self(spark, **args).first()

    def stream(self, spark: SparkSession, **args) -> Iterator[Row]:
        """Rows as they are reached; for a query that reads, marked ``@stream`` or not."""
        return lazy_rows(self(spark, **args))

    def check_shape(self, schema: T.StructType) -> None:
        """Result names and asserted types, once per query; an assertion never casts."""
        if self._checked:
            return
        low = [n.lower() for n in schema.names]
        if len(set(low)) < len(low):
            raise ShapeError(f"{self.name}: two result columns have one name: {schema.names}")
        for alias, kind in self.directives.types.items():
            got = next((f.dataType for f in schema if f.name.lower() == alias.lower()), None)
            want = spark_type(kind, self.dialect)
            if got is None:
                raise ShapeError(f"{self.name}: @type names {alias}, which is no result column")
            if want is not None and got != want and not isinstance(want, T.DecimalType):
                raise ShapeError(f"{self.name}: {alias} is {got.simpleString()}, asserted {kind}")
        if self.directives.result and self.directives.result.startswith("("):
            want_names = [p.split()[-1].lower() for p in split_top(self.directives.result.strip("()"))]
            if want_names != low:
                raise ShapeError(f"{self.name}: result is {schema.names}, declared {want_names}")
        self._checked = True


class QueryCatalog:
    """Queries by ``Entity.Method``; reads each file once per content and schema."""

    _cache: dict[tuple, Query] = {}

    def __init__(self, snapshot: Snapshot | None = None, dialect: str = "native"):
        self.snapshot, self.dialect = snapshot, dialect
        self.queries: dict[str, Query] = {}
        self.procedures: dict[str, Callable] = {}

    def add(self, name: str, source: str, path: str = "") -> Query:
        key = (name, source, self.dialect, id(self.snapshot))
        q = self._cache.get(key)
        if q is None or q.snapshot is not self.snapshot:
            q = self._cache[key] = Query(name, source, self.dialect, self.snapshot, path)
        if name in self.queries and self.queries[name].path != path:
            raise ValueError(f"{name} is defined by {self.queries[name].path} and {path}")
        self.queries[name] = q
        return q

    def load(self, folder: str) -> QueryCatalog:
        for path in sorted(Path(folder).rglob("*.sql")):
            entity, method = entity_and_method(str(path), folder)
            self.add(f"{entity}.{method}", path.read_text(), str(path))
        return self

    def __getitem__(self, name: str) -> Query:
        return self.queries[name]

    def register_procedure(self, name: str, body: Callable) -> None:
        """``body(spark, **in_args) -> (DataFrame or count, {out name: value})``."""
        self.procedures[name.lower()] = body

    def call(self, spark: SparkSession, procedure: str, **args):
        """Result and out values of a procedure, checked against its declaration."""
        declared = next((p for p in (self.snapshot.procedures if self.snapshot else []) if p.name.lower() == procedure.lower()), None)
        body = self.procedures.get(procedure.lower())
        if body is None:
            raise KeyError(f"no procedure {procedure}")
        if declared:
            ins = {p.name.lstrip("@").lower() for p in declared.parameters if p.direction in ("In", "InOut")}
            if {a.lower() for a in args} != ins:
                raise ParameterError(f"{procedure}: takes {sorted(ins)}")
        result, out = body(spark, **args)
        if declared and isinstance(result, DataFrame) and declared.result_columns:
            want = [c.name.lower() for c in declared.result_columns]
            if [c.lower() for c in result.columns] != want:
                raise ShapeError(f"{procedure}: returned {result.columns}, declared {want}")
        if declared:
            outs = {p.name.lstrip("@").lower() for p in declared.parameters if p.direction != "In"}
            if {k.lower() for k in out} != outs:
                raise ShapeError(f"{procedure}: out values {sorted(out)}, declared {sorted(outs)}")
        return result, out
