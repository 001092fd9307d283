"""The declared schema: tables, keys, indexes, foreign keys, enums, functions, procedures, sequences."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import db_type_of, spark_type

DIALECTS = ("sqlserver", "postgres", "mysql", "sqlite", "native")


class SnapshotError(ValueError):
    pass


@dataclass
class Column:
    name: str
    db_type: str
    is_nullable: bool = True
    is_primary_key: bool = False
    is_identity: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    is_unicode: bool | None = None
    is_row_version: bool = False
    is_computed: bool = False
    enum_name: str | None = None
    resolved_from_user_type: str | None = None


@dataclass
class Index:
    name: str
    columns: list[str]
    is_unique: bool = False
    has_prefix_keys: bool = False
    has_expression_keys: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    is_view: bool = False

    def column(self, name: str) -> Column | None:
        return _named(self.columns, name)

    @property
    def key(self) -> list[Column]:
        return [c for c in self.columns if c.is_primary_key]


@dataclass
class ForeignKey:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    name: str | None = None


@dataclass
class Param:
    name: str
    db_type: str
    direction: str = "In"


@dataclass
class Procedure:
    name: str
    parameters: list[Param] = field(default_factory=list)
    result_columns: list[Column] = field(default_factory=list)


@dataclass
class Function:
    name: str
    return_type: str = ""
    parameters: list[Param] = field(default_factory=list)


@dataclass
class Sequence:
    name: str
    start: int = 1
    increment: int = 1
    min_value: int | None = None
    max_value: int | None = None


@dataclass
class Enum:
    name: str
    values: list[str] = field(default_factory=list)


@dataclass
class UserType:
    name: str
    kind: str = "Alias"  # Alias, Domain, Composite, TableType
    base_type: str | None = None
    columns: list[Column] = field(default_factory=list)


@dataclass
class Snapshot:
    dialect: str = "native"
    tables: list[Table] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    procedures: list[Procedure] = field(default_factory=list)
    sequences: list[Sequence] = field(default_factory=list)
    enums: list[Enum] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)
    user_types: list[UserType] = field(default_factory=list)

    def table(self, name: str) -> Table | None:
        """Exact name first, then in any case; schema qualifiers do not matter."""
        return _named(self.tables, name.split(".")[-1])

    def clone(self) -> Snapshot:
        return copy.deepcopy(self)

    @property
    def has_indexes(self) -> bool:
        return any(t.indexes for t in self.tables)

    def foreign_groups(self) -> dict[tuple[str, str], list[tuple[str, str]]]:
        """Column pairs of each (child, parent), in lower case."""
        out: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for f in self.foreign_keys:
            out.setdefault((f.from_table.lower(), f.to_table.lower()), []).append((f.from_column.lower(), f.to_column.lower()))
        return out


def _named(items, name: str):
    return next((x for x in items if x.name == name), None) or next((x for x in items if x.name.lower() == name.lower()), None)


_PARTS = {"columns": Column, "indexes": Index, "tables": Table, "foreign_keys": ForeignKey, "procedures": Procedure, "sequences": Sequence, "enums": Enum, "functions": Function, "user_types": UserType, "parameters": Param, "result_columns": Column}


def _snake(key: str) -> str:
    out = "".join("_" + c.lower() if c.isupper() else c for c in key).lstrip("_")
    return {"db_type": "db_type", "type": "db_type"}.get(out, out)


def _build(cls, raw: dict, where: str):
    if not isinstance(raw, dict):
        raise SnapshotError(f"{where}: an entry is null or no object")
    known = {f.name for f in fields(cls)}
    low = {k.replace("_", "").lower(): k for k in known}
    args = {}
    for key, value in raw.items():
        name = low.get(key.replace("_", "").lower())
        if name is None or value is None:
            continue
        if cls is Index and name == "columns":
            value = [c["name"] if isinstance(c, dict) else c for c in value]
        elif name in _PARTS:
            items = [{"name": k, **v} for k, v in value.items()] if isinstance(value, dict) else value
            value = [_build(_PARTS[name], x, f"{where}.{name}") for x in items]
            names = [x.name.lower() for x in value if getattr(x, "name", None)]
            twice = {n for n in names if names.count(n) > 1}
            if twice and cls is not Snapshot or twice and name in ("tables", "sequences", "enums"):
                raise SnapshotError(f"{where}.{name}: {sorted(twice)[0]} is there twice")
        args[name] = value
    try:
        return cls(**args)
    except TypeError as e:
        raise SnapshotError(f"{where}: {e}") from None


def load_snapshot(source: str | Path | dict) -> Snapshot:
    """From JSON text, a file or a dict; keys in camel case or snake case, in any case."""
    if not isinstance(source, dict):
        text = source if isinstance(source, str) and source.lstrip().startswith("{") else Path(source).read_text()
        source = json.loads(text)
    return _build(Snapshot, source, "snapshot")


def to_json(s: Snapshot) -> str:
    def plain(x):
        if isinstance(x, list):
            return [plain(i) for i in x]
        if hasattr(x, "__dataclass_fields__"):
            out = {}
            for f in fields(x):
                v = plain(getattr(x, f.name))
                if v is None or v is False and f.name != "is_nullable" or v == []:
                    continue
                head, *rest = f.name.split("_")
                out[head + "".join(r.title() for r in rest)] = v
            return out
        return x

    return json.dumps(plain(s), indent=2, ensure_ascii=False)


def infer(spark: SparkSession, paths: dict[str, str], keys: dict[str, list[str]] | None = None, foreign: list[tuple[str, str, str, str]] = ()) -> Snapshot:
    """A snapshot from Parquet footers, with keys and foreign keys as declared by the caller."""
    keys = keys or {}
    tables = []
    for name, path in paths.items():
        cols = [Column(f.name, db_type_of(f.dataType), f.name not in keys.get(name, []), f.name in keys.get(name, [])) for f in spark.read.parquet(path).schema]
        tables.append(Table(name, cols))
    return Snapshot("native", tables, [ForeignKey(*f) for f in foreign])


def struct_of(table: Table, dialect: str) -> T.StructType:
    """The declared Spark schema of a table; facets go to metadata."""
    out = []
    for c in table.columns:
        kind = spark_type(c.db_type, dialect, c.precision, c.scale) or T.StringType()
        meta = {k: v for k, v in (("dbType", c.db_type), ("maxLength", c.max_length), ("isIdentity", c.is_identity), ("isRowVersion", c.is_row_version)) if v}
        out.append(T.StructField(c.name, kind, c.is_nullable, meta))
    return T.StructType(out)


def verify(declared: Snapshot, live: Snapshot) -> list[tuple[str, str]]:
    """(breaking | compatible | info, message) of a live schema against the declared one."""
    from ..plans.evolve import diff

    out = []
    for d in diff(declared, live):
        if d.kind == "table-added":
            out.append(("info", f"{d.table} is live only"))
        elif d.kind in ("column-added", "null-allowed", "widened"):
            out.append(("compatible", d.describe()))
        else:
            out.append(("breaking", d.describe()))
    for t in declared.tables:
        other = live.table(t.name)
        if other:
            a = [c.name.lower() for c in t.columns if other.column(c.name)]
            b = [c.name.lower() for c in other.columns if t.column(c.name)]
            if a != b:
                out.append(("breaking", f"{t.name}: columns stand in another order"))
    return out


def check_enums(df: DataFrame, table: Table, snapshot: Snapshot) -> DataFrame:
    """Rows whose enum columns hold something that is no member."""
    bad = None
    for c in table.columns:
        enum = _named(snapshot.enums, c.enum_name) if c.enum_name else None
        if enum and enum.values:
            test = df[c.name].isNotNull() & ~df[c.name].isin(enum.values)
            bad = test if bad is None else bad | test
    return df.limit(0) if bad is None else df.where(bad)
