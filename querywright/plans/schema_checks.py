"""Findings on a declared schema itself, before any query is read."""

from __future__ import annotations

import keyword
import re

from ..functions.types import spark_type
from ..operators.crud import CrudError, competing_unique, upsert_key
from ..sources.snapshot import Snapshot
from .lint import Finding


def accessor(name: str) -> str:
    """The Python name of a database object: words in lower case, joined by marks."""
    plain = re.sub(r"\W+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.rsplit(".", 1)[-1])).strip("_").lower()
    return f"{plain}_" if keyword.iskeyword(plain) else f"_{plain}" if plain[:1].isdigit() else plain


def check_schema(s: Snapshot) -> list[Finding]:
    out: list[Finding] = []
    add = lambda code, text: out.append(Finding(code, text))
    if not s.tables:
        add("no-schema", "no tables are declared")
    for t in s.tables:
        if not t.columns:
            add("table-skipped", f"{t.name} has no columns")
        for i in t.indexes:
            if i.is_unique and i.has_prefix_keys:
                add("prefix-key", f"{t.name}.{i.name} is unique by beginnings of values only: no key for an upsert")
            if i.is_unique and i.has_expression_keys:
                add("expression-key", f"{t.name}.{i.name} is unique by expressions: no key for an upsert")
        try:
            others = [] if t.is_view else competing_unique(t)
            if others:
                add("non-atomic-upsert", f"{t.name}: an upsert by {upsert_key(t)} can collide in {[i.name for i in others]}")
        except CrudError:
            pass
        names: dict[str, str] = {}
        for c in t.columns:
            plain = accessor(c.name)
            if plain in names:
                add("lossy-rename", f"{t.name}: {names[plain]} and {c.name} have one name in Python")
            names.setdefault(plain, c.name)
    seen: dict[str, str] = {}
    for q in s.sequences:
        plain = accessor(q.name)
        if plain in seen:
            add("sequence-duplicate", f"{seen[plain]} and {q.name}")
        seen.setdefault(plain, q.name)
    for e in s.enums:
        members: dict[str, str] = {}
        for v in e.values:
            plain = accessor(v)
            if not plain or plain in members:
                add("enum-member", f"{e.name}: {v!r} has no name of its own")
            members.setdefault(plain, v)
    tables = {u.name.lower() for u in s.user_types if u.kind == "TableType"}
    made: dict[tuple, str] = {}
    for f in s.functions:
        key = (accessor(f.name), len(f.parameters))
        if key in made:
            add("function-collision", f"{f.name} and {made[key]} take as many parameters")
        made.setdefault(key, f.name)
        for p in f.parameters:
            if p.db_type.lower() in tables:
                add("table-parameter", f"{f.name}: {p.name} is a table")
            elif spark_type(p.db_type, s.dialect) is None:
                add("function-unmappable", f"{f.name}: {p.name} is {p.db_type}")
        if f.return_type and spark_type(f.return_type, s.dialect) is None:
            add("function-unmappable", f"{f.name} returns {f.return_type}")
    for p in s.procedures:
        for x in p.parameters:
            if x.db_type.lower() in tables:
                add("table-parameter", f"{p.name}: {x.name} is a table")
    return out
