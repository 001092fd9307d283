"""Schemas of live databases: SQLite by the standard library, others by JDBC catalogs, and tables as views."""

from __future__ import annotations

import sqlite3

from pyspark.sql import SparkSession

from .snapshot import Column, ForeignKey, Index, Snapshot, Table


def from_sqlite(path: str) -> Snapshot:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    s = Snapshot("sqlite")
    for name, kind in db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name"):
        info = db.execute(f'PRAGMA table_xinfo("{name}")').fetchall()
        keys = [r[1] for r in info if r[5]]
        table = Table(name, is_view=kind == "view")
        for _, col, db_type, not_null, _, pk, hidden in info:
            # one INTEGER PRIMARY KEY is the row id
            identity = bool(pk) and len(keys) == 1 and db_type.upper() == "INTEGER"
            table.columns.append(Column(col, (db_type or "text").lower(), not (not_null or pk), bool(pk), identity, is_computed=hidden in (2, 3)))
        for _, index, unique, *_ in db.execute(f'PRAGMA index_list("{name}")').fetchall():
            cols = [r[2] for r in db.execute(f'PRAGMA index_info("{index}")')]
            table.indexes.append(Index(index, [c for c in cols if c], bool(unique), has_expression_keys=None in cols))
        s.tables.append(table)
        for r in db.execute(f'PRAGMA foreign_key_list("{name}")').fetchall():
            s.foreign_keys.append(ForeignKey(name, r[3], r[2], r[4] or ""))
    db.close()
    for f in s.foreign_keys:
        parent = s.table(f.to_table)
        if not f.to_column and parent and parent.key:
            f.to_column = parent.key[0].name
    return s


_COLUMNS = {
    "postgres": "SELECT table_name, column_name, data_type, is_nullable, character_maximum_length, numeric_precision, numeric_scale FROM information_schema.columns WHERE table_schema NOT IN ('pg_catalog', 'information_schema') ORDER BY table_name, ordinal_position",
    "mysql": "SELECT table_name, column_name, data_type, is_nullable, character_maximum_length, numeric_precision, numeric_scale FROM information_schema.columns WHERE table_schema = database() ORDER BY table_name, ordinal_position",
    "sqlserver": "SELECT TABLE_NAME, COLUMN_NAME, DATA_TYPE, IS_NULLABLE, CHARACTER_MAXIMUM_LENGTH, NUMERIC_PRECISION, NUMERIC_SCALE FROM INFORMATION_SCHEMA.COLUMNS",
}
_KEYS = "SELECT k.table_name, k.column_name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_name = k.constraint_name AND c.table_name = k.table_name WHERE c.constraint_type = 'PRIMARY KEY'"


def from_jdbc(spark: SparkSession, url: str, dialect: str, **options) -> Snapshot:
    """Columns and primary keys by the catalogs that the SQL standard names; needs the driver's jar."""

    def read(sql):
        return spark.read.format("jdbc").options(url=url, query=sql, **options).load().collect()

    s = Snapshot(dialect)
    keys = {(r[0], r[1]) for r in read(_KEYS)}
    for name, col, kind, null, length, p, scale in read(_COLUMNS[dialect]):
        table = s.table(name) or s.tables.append(Table(name)) or s.tables[-1]
        table.columns.append(Column(col, kind, null == "YES", (name, col) in keys, max_length=length, precision=p, scale=scale))
    return s


_REGISTERED: dict[tuple, str] = {}


def register(spark: SparkSession, folder: str, tables: list[str]) -> None:
    """Parquet tables as temporary views, those of another folder or session only; footers are read here."""
    for t in tables:
        key = (id(spark), spark.sparkContext.applicationId, t)
        if _REGISTERED.get(key) != folder or not spark.catalog.tableExists(t):
            spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
            _REGISTERED[key] = folder


def forget() -> None:
    """Views may have been replaced by others of their names."""
    _REGISTERED.clear()
