"""Versioned Parquet tables: every write makes a new version, and one manifest says which are current.

A transaction stages versions and swaps the manifest once, so several tables change together or not at
all.  One writer at a time, held by a lock file that is created exclusively; readers keep the versions
that they opened.  All files go through Spark's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import Sequence, Snapshot
from . import crud


class StoreError(RuntimeError):
    pass


class TableStore:
    def __init__(self, spark: SparkSession, root: str, snapshot: Snapshot):
        self.spark, self.root, self.snapshot = spark, root.rstrip("/"), snapshot
        self.staged: dict[str, str] | None = None
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _read_text(self, name: str) -> str | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _numbers(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))

    def manifest(self) -> dict:
        """The newest one; the one before is kept for readers that are about to open it."""
        last = self._numbers()[-1:]
        return json.loads(self._read_text(f"manifest-{last[0]:012d}") if last else '{"tables": {}, "sequences": {}, "identities": {}}')

    def break_lock(self) -> None:
        """Free the store from a writer that has died; its versions were never current."""
        self._fs.delete(self._path(f"{self.root}/lock"), False)

    @contextmanager
    def transaction(self) -> Iterator[TableStore]:
        """All writes inside become current together; an exception leaves everything as it was."""
        if self.staged is not None:
            yield self  # calls inside enlist
            return
        try:
            self._write_text("lock", "", overwrite=False)
        except Exception as e:
            raise StoreError("another writer holds the store") from e
        m = self.manifest()
        self.staged, self._meta = dict(m["tables"]), m
        try:
            yield self
            m = self._meta | {"tables": self.staged}
            # Written beside, then renamed to the next number: a reader sees the old one or the new one, whole.
            tmp = f"writing-{uuid.uuid4().hex}"
            self._write_text(tmp, json.dumps(m))
            last = self._numbers()[-1:] or [0]
            if not self._fs.rename(self._path(f"{self.root}/{tmp}"), self._path(f"{self.root}/manifest-{last[0] + 1:012d}")):
                raise StoreError("the manifest could not be renamed")
            for k in self._numbers()[:-2]:
                self._fs.delete(self._path(f"{self.root}/manifest-{k:012d}"), False)
        finally:
            self.staged = None
            self._fs.delete(self._path(f"{self.root}/lock"), False)

    def read(self, table: str) -> DataFrame:
        version = (self.staged if self.staged is not None else self.manifest()["tables"]).get(table)
        if not version:
            raise StoreError(f"no table {table}")
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in version.split("|")])

    def write(self, table: str, df: DataFrame, append: bool = False) -> None:
        """A new version; an append keeps the files of the old one and adds its own."""
        with self.transaction():
            part = f"{table}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{part}")
            before = self.staged.get(table)
            self.staged[table] = f"{before}|{part}" if append and before else part

    def insert(self, table: str, rows, scope: dict | None = None) -> int | list[int]:
        """Rows added, or the ids given on a table with one identity column; only the new rows are written."""
        t = self.snapshot.table(table)
        with self.transaction():
            base = self.read(table)
            new = crud.insert(base.limit(0), t, rows, scope)
            return self._append(t, base, new, None if isinstance(rows, DataFrame) else list(range(len(rows))))

    def _append(self, t, base: DataFrame, new: DataFrame, places: list[int] | None = None) -> int | list[int]:
        """Add rows; where the table has one identity column they get ids in the order of the rows, and the ids are
        returned for rows that were given one by one."""
        ident = [c.name for c in t.columns if c.is_identity]
        if len(ident) != 1:
            self.write(t.name, new, append=True)
            return new.count()
        last = self._meta["identities"].get(t.name)
        last = last if last is not None else base.agg(F.max(ident[0])).first()[0] or 0
        new = crud.numbered(new, ident[0], last).select(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in base.columns])
        self.write(t.name, new, append=True)
        n = len(places) if places is not None else new.count()
        self._meta["identities"][t.name] = last + n
        return list(range(last + 1, last + n + 1)) if places is not None else n

    def execute(self, query, **args):
        """Run a writing statement of a catalog and commit it."""
        with self.transaction():
            change = query.change(self.spark, self.read, **args)
            t = self.snapshot.table(change.table)
            if change.added is not None and query.statement.kind == "INSERT" and not query.statement.upsert:
                base = self.read(change.table)
                got = self._append(t, base, change.added, list(range(change.added.count())) if query.directives.identity else None)
                return got if query.directives.identity or not query.statement.returning else change.rows
            # Lazy frames keep the version of the table that they read.
            rows = change.rows
            n = rows.count()
            if n:
                self.write(change.table, change.content)
            return rows if query.statement.returning else n

    def update(self, table: str, key: dict, values: dict, scope: dict | None = None, version: tuple[str, int] | None = None) -> int:
        """Rows changed; with (column, value) of a version, 0 if it is stale."""
        t = self.snapshot.table(table)
        with self.transaction():
            base = self.read(table)
            if version:
                new, n = crud.versioned_update(base, key | (scope or {}), values, *version)
            else:
                new, cond = crud.update(base, t, key, values, scope)
                n = base.where(cond).count()
            if n:
                self.write(table, new)
            return n

    def delete(self, table: str, key: dict, scope: dict | None = None) -> int:
        t = self.snapshot.table(table)
        with self.transaction():
            base = self.read(table)
            new, cond = crud.delete(base, t, key, scope)
            n = base.where(cond).count()
            if n:
                self.write(table, new)
            return n

    def upsert(self, table: str, rows, on_match: str = "update") -> None:
        with self.transaction():
            self.write(table, crud.upsert(self.read(table), self.snapshot.table(table), rows, on_match))

    def next_value(self, name: str) -> int:
        """The next number of a declared sequence; numbers are never given twice."""
        s = next((x for x in self.snapshot.sequences if x.name.lower() == name.lower()), None) or Sequence(name)
        with self.transaction():
            last = self._meta["sequences"].get(s.name)
            value = s.start if last is None else last + s.increment
            if s.max_value is not None and value > s.max_value or s.min_value is not None and value < s.min_value:
                raise StoreError(f"sequence {s.name} is used up")
            self._meta["sequences"][s.name] = value
            return value
