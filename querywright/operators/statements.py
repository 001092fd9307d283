"""Statements that write, as transformations of the target's frame.

INSERT (values or select), UPDATE (also FROM), DELETE, with ON CONFLICT, ON DUPLICATE KEY and RETURNING, become
SELECTs over the target: the new content, and the rows that changed.  Spark plans them; a store commits the new
content.  A condition that is null changes nothing.  Of new rows with one key the last wins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lexer import Token, qualified, tokenize
from ..plans.model import _split, _top
from ..plans.rewrite import closing, expression
from ..sources.snapshot import Table
from . import crud


class WriteError(ValueError):
    pass


@dataclass
class Change:
    """``content``: all rows of the table after the statement; ``added``: the new rows if the others stay as they are;
    ``rows``: those inserted, updated (as they are now) or deleted (as they were), by RETURNING or whole."""

    table: str
    content: DataFrame
    rows: DataFrame
    added: DataFrame | None = None


def _same(columns: list[str], a: str, b: str) -> str:
    return " AND ".join(f"{a}.`{c}` = {b}.`{c}`" for c in columns)


class Writer:
    def __init__(self, spark: SparkSession, sql: str, dialect: str, table_of: Callable[[str], Table | None], frame_of: Callable[[str], DataFrame], args: dict, kinds: dict[str, str] | None = None):
        tokens = tokenize(sql)
        while tokens and tokens[-1].is_(";"):
            tokens.pop()
        self.spark, self.dialect, self.args, self.kinds = spark, dialect, args, kinds or {}
        self.table_of, self.frame_of = table_of, frame_of
        end = _top(tokens, 0, "RETURNING")
        self.returning, self.tokens = tokens[end + 1 :], tokens[:end]

    def text(self, tokens: list[Token]) -> str:
        return expression(tokens, self.dialect, self.kinds)

    def sql(self, text: str) -> DataFrame:
        used = {t.value for t in tokenize(text.replace(":", "@")) if t.kind == "param"}
        return self.spark.sql(text, args={k: v for k, v in self.args.items() if k in used})

    def target(self, i: int) -> tuple[str, int]:
        parts, i = qualified(self.tokens, i)
        self.name = parts[-1]
        self.table = self.table_of(self.name)
        if self.table is None:
            raise WriteError(f"no table {self.name}")
        crud._writable(self.table)
        self.base = self.frame_of(self.name)
        self.base.createOrReplaceTempView(self.name)
        return self.name, i

    def returned(self, rows: DataFrame) -> DataFrame:
        if not self.returning:
            return rows
        rows.createOrReplaceTempView("__changed")
        return self.sql(f"SELECT {self.text(self.returning)} FROM __changed AS `{self.name}`")

    def run(self) -> Change:
        kind = self.tokens[0].upper if self.tokens else ""
        if kind == "INSERT":
            return self.insert()
        if kind == "UPDATE":
            return self.update()
        if kind == "DELETE":
            return self.delete()
        raise WriteError(f"{kind} does not write")

    def typed(self, rows: DataFrame) -> DataFrame:
        """Columns of the target in its types; those not given are null."""
        return rows.select(*self.casts(rows))

    def casts(self, rows: DataFrame) -> list[Column]:
        return [(F.col(c) if c in rows.columns else F.lit(None)).cast(self.base.schema[c].dataType).alias(c) for c in self.base.columns]

    def new_rows(self, i: int) -> tuple[DataFrame, int]:
        tokens = self.tokens
        columns = self.base.columns
        if tokens[i].is_("("):
            end = closing(tokens, i)
            columns = [t.value for t in tokens[i + 1 : end] if t.kind in ("word", "name")]
            i = end + 1
        known = {c.lower(): c for c in self.base.columns}
        columns = [known.get(c.lower(), c) for c in columns]
        wrong = [c for c in columns if c not in self.base.columns] + [c.name for c in self.table.columns if c.name in columns and (c.is_computed or c.is_row_version)]
        if wrong:
            raise WriteError(f"{self.name}: {wrong} cannot be given")
        stop = next((k for k in range(i, len(tokens)) if tokens[k].is_("ON") and k + 1 < len(tokens) and tokens[k + 1].upper in ("CONFLICT", "DUPLICATE")), len(tokens))
        if tokens[i].is_("VALUES"):
            parts = []
            for row in _split(tokens[i + 1 : stop], ","):
                values = _split(row[1:-1], ",")
                if len(values) != len(columns):
                    raise WriteError(f"{self.name}: {len(values)} values for {len(columns)} columns")
                parts.append("SELECT " + ", ".join("NULL" if len(v) == 1 and v[0].upper == "DEFAULT" else self.text(v) for v in values))
            rows = self.sql(" UNION ALL ".join(f"{p}, {k}" for k, p in enumerate(parts)))
        else:
            rows = self.sql(self.text(tokens[i:stop])).withColumn("_at", F.lit(0))
        if len(rows.columns) != len(columns) + 1:
            raise WriteError(f"{self.name}: {len(rows.columns) - 1} values for {len(columns)} columns")
        rows = rows.toDF(*columns, "_at")
        return rows.select(*self.casts(rows), "_at"), stop

    def insert(self) -> Change:
        _, i = self.target(2 if self.tokens[1].is_("INTO") else 1)
        rows, i = self.new_rows(i)
        if i >= len(self.tokens):
            added = rows.drop("_at")
            return Change(self.name, self.base.unionByName(added), self.returned(added), added)
        return self.upsert(rows, i)

    def upsert(self, rows: DataFrame, i: int) -> Change:
        tokens = self.tokens[i:]
        j = 2
        key = crud.upsert_key(self.table)
        if tokens[1].upper == "CONFLICT" and len(tokens) > 2 and tokens[2].is_("("):
            end = closing(tokens, 2)
            key = [t.value for t in tokens[3:end] if t.kind in ("word", "name")]
            j = end + 1
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), "_at").alias("_v")).select(*key, "_v.*").drop("_at")
        # Null keys meet nothing: each such row is new.
        whole = " AND ".join(f"`{c}` IS NOT NULL" for c in key)
        new = last.select(*self.base.columns).where(whole).unionByName(rows.where(f"NOT ({whole})").drop("_at"))
        new.createOrReplaceTempView("__excluded")
        on = _same(key, self.name, "excluded")
        fresh = self.sql(f"SELECT excluded.* FROM __excluded AS excluded LEFT ANTI JOIN `{self.name}` ON {on}")
        if any(t.upper == "NOTHING" for t in tokens):
            return Change(self.name, self.base.unionByName(fresh), self.returned(fresh), fresh)
        at = _top(tokens, j, "SET") if tokens[1].upper == "CONFLICT" else next(k for k in range(len(tokens)) if tokens[k].is_("UPDATE"))
        end = _top(tokens, at + 1, "WHERE")
        sets = self.sets(_excluded(tokens[at + 1 : end]))
        hit = f"excluded.`{key[0]}` IS NOT NULL" + (f" AND coalesce({self.text(_excluded(tokens[end + 1 :]))}, false)" if end < len(tokens) else "")
        named = {c: f"`{self.name}`.`{c}`" for c in self.base.columns}
        columns = ", ".join(f"CASE WHEN {hit} THEN {sets[c]} ELSE {named[c]} END AS `{c}`" if c in sets else f"{named[c]} AS `{c}`" for c in self.base.columns)
        joined = f"FROM `{self.name}` LEFT JOIN __excluded AS excluded ON {on}"
        kept = self.typed(self.sql(f"SELECT {columns} {joined}"))
        changed = self.typed(self.sql(f"SELECT {columns} {joined} WHERE {hit}"))
        return Change(self.name, kept.unionByName(fresh), self.returned(changed.unionByName(fresh)))

    def sets(self, tokens: list[Token]) -> dict[str, str]:
        known, out = {c.lower(): c for c in self.base.columns}, {}
        fixed = {c.name for c in self.table.columns if c.is_computed or c.is_identity or c.is_row_version}
        for part in _split(tokens, ","):
            eq = next(k for k, t in enumerate(part) if t.is_("="))
            column = known.get(part[eq - 1].value.lower())
            if column is None or column in fixed:
                raise WriteError(f"{self.name}: {part[eq - 1].value} cannot be set")
            out[column] = self.text(part[eq + 1 :])
        return out

    def alias(self, i: int) -> tuple[str, int]:
        t = self.tokens
        i += i < len(t) and t[i].is_("AS")
        if i < len(t) and t[i].kind in ("word", "name") and not t[i].is_("SET", "WHERE", "FROM", "USING"):
            return t[i].value, i + 1
        return self.name, i

    def update(self) -> Change:
        _, i = self.target(1)
        alias, i = self.alias(i)
        end = _top(self.tokens, i + 1, "WHERE", "FROM")
        sets = self.sets(self.tokens[i + 1 : end])
        source = []
        if end < len(self.tokens) and self.tokens[end].is_("FROM"):
            stop = _top(self.tokens, end + 1, "WHERE")
            source, end = self.tokens[end + 1 : stop], stop
        where = self.text(self.tokens[end + 1 :]) if end < len(self.tokens) else "true"
        if source:
            return self.update_from(alias, sets, self.text(source), where)
        columns = ", ".join(f"CASE WHEN coalesce({where}, false) THEN {sets[c]} ELSE `{alias}`.`{c}` END AS `{c}`" if c in sets else f"`{alias}`.`{c}`" for c in self.base.columns)
        now = ", ".join(f"{sets[c]} AS `{c}`" if c in sets else f"`{alias}`.`{c}`" for c in self.base.columns)
        content = self.typed(self.sql(f"SELECT {columns} FROM `{self.name}` AS `{alias}`"))
        return Change(self.name, content, self.returned(self.typed(self.sql(f"SELECT {now} FROM `{self.name}` AS `{alias}` WHERE {where}"))))

    def update_from(self, alias: str, sets: dict[str, str], source: str, where: str) -> Change:
        """A row that meets several of the source takes the values of any one, as the standard has it."""
        key = [c.name for c in self.table.key]
        if not key:
            raise WriteError(f"{self.name} has no key to update by")
        columns = list(sets)
        met = self.sql(f"SELECT {', '.join(f'`{alias}`.`{c}` AS `_k{k}`' for k, c in enumerate(key))}, {', '.join(f'{sets[c]} AS `_n{k}`' for k, c in enumerate(columns))} FROM `{self.name}` AS `{alias}`, {source} WHERE {where}")
        met = met.dropDuplicates([f"_k{k}" for k in range(len(key))]).withColumn("_hit", F.lit(True))
        on = F.lit(True)
        for k, c in enumerate(key):
            on = on & (self.base[c] == met[f"_k{k}"])
        new = lambda c: F.col(f"_n{columns.index(c)}")
        joined = self.base.join(met, on, "left")
        content = joined.select(*[F.when(F.col("_hit"), new(c)).otherwise(self.base[c]).alias(c) if c in sets else self.base[c] for c in self.base.columns])
        rows = joined.where("_hit").select(*[new(c).alias(c) if c in sets else self.base[c] for c in self.base.columns])
        return Change(self.name, self.typed(content), self.returned(self.typed(rows)))

    def delete(self) -> Change:
        _, i = self.target(2 if self.tokens[1].is_("FROM") else 1)
        alias, i = self.alias(i)
        where = self.text(self.tokens[i + 1 :]) if i < len(self.tokens) else "true"
        content = self.sql(f"SELECT * FROM `{self.name}` AS `{alias}` WHERE NOT coalesce({where}, false)")
        return Change(self.name, content, self.returned(self.sql(f"SELECT * FROM `{self.name}` AS `{alias}` WHERE {where}")))


def _excluded(tokens: list[Token]) -> list[Token]:
    """``VALUES(c)`` of one dialect is ``excluded.c`` of the others."""
    out, i = [], 0
    while i < len(tokens):
        if tokens[i].is_("VALUES") and i + 3 < len(tokens) and tokens[i + 1].is_("(") and tokens[i + 3].is_(")"):
            out += [Token("word", "excluded", "excluded", tokens[i].at), Token("symbol", ".", ".", tokens[i].at), tokens[i + 2]]
            i += 4
        else:
            out.append(tokens[i])
            i += 1
    return out
