"""Tenant scope: proof that each reach of a scoped table is held to one tenant, where SQL applies it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..sources.snapshot import Snapshot
from .lexer import Token
from .model import Ref, Statement


@dataclass
class ScopePolicy:
    """Table -> tenant column, both in lower case."""

    columns: dict[str, str] = field(default_factory=dict)
    problems: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def load(cls, text: str, snapshot: Snapshot) -> ScopePolicy:
        out = cls()
        try:
            entries = json.loads(text)["scopes"]
        except (ValueError, KeyError, TypeError):
            out.problems.append(("bad-scope-file", "no list of scopes"))
            return out
        for e in entries:
            table = snapshot.table(str(e.get("table", ""))) if isinstance(e, dict) else None
            column = table.column(str(e.get("column", ""))) if table else None
            if not column:
                out.problems.append(("bad-scope-entry", f"{e} names no table and column"))
            elif table.name.lower() in out.columns:
                out.problems.append(("bad-scope-entry", f"{table.name} is there twice"))
            else:
                out.columns[table.name.lower()] = column.name.lower()
        return out


def _proves(atom: list[Token], refs: set[str], column: str, bare: bool, excluded: bool = False) -> bool:
    """``ref.column = @p`` or the other way round, and nothing else."""
    parts, at = [], 0
    for k, t in enumerate(atom):
        if t.is_("="):
            parts.append(atom[at:k])
            at = k + 1
    parts.append(atom[at:])
    if len(parts) != 2:
        return False
    for a, b in (parts, parts[::-1]):
        given = len(b) == 1 and b[0].kind == "param" or excluded and [t.value.lower() for t in b] == ["excluded", ".", column]
        name = [t.value.lower() for t in a]
        if given and (len(name) == 3 and name[1] == "." and name[0] in refs and name[2] == column or bare and name == [column]):
            return True
    return False


def _places(s: Statement, r: Ref) -> list[list[Token]]:
    """Atoms that hold for every row that the reference gives."""
    at = next(k for k, x in enumerate(s.tables) if x is r)
    later = [x for x in s.tables[at + 1 :] if x.join in ("RIGHT", "FULL")]
    if r.join == "FULL" or any(x.join == "FULL" for x in later):
        return s.atoms
    if r.join == "LEFT":
        return r.on
    if later:
        return r.on + [a for x in later for a in x.on]
    inner = [a for x in s.tables if x.join in ("INNER", "NATURAL", "CROSS") for a in x.on]
    return s.atoms + inner


def scope_findings(s: Statement, snapshot: Snapshot, policy: ScopePolicy) -> list[tuple[str, str]]:
    out = []
    for x in s.every():
        real = [r for r in x.tables if snapshot.table(r.name) and r.name.lower() not in s.ctes]
        for r in real:
            column = policy.columns.get(r.name.lower())
            if not column:
                continue
            refs, bare = {r.alias.lower()}, len(real) == 1
            if x.kind == "INSERT" and r.join == "TARGET":
                if not any(b.write and b.column and b.column[1].lower() == column for b in x.bindings):
                    out.append(("unscoped-reach", f"{r.name}: {column} is not a parameter of the insert"))
                if x.upsert == "duplicate-key":
                    out.append(("unscoped-reach", f"{r.name}: ON DUPLICATE KEY cannot be scoped"))
                elif x.upsert == "update":
                    if any(_proves(a, refs, column, True, True) for a in x.upsert_atoms):
                        out.append(("scoped-upsert", f"{r.name}: another tenant's row is left alone"))
                    else:
                        out.append(("unscoped-reach", f"{r.name}: the update branch is not scoped"))
                continue
            atoms = x.atoms if r.join == "TARGET" else _places(x, r)
            if not any(_proves(a, refs, column, bare) for a in atoms):
                out.append(("unscoped-reach", f"{r.name} is reached without {column} = @parameter"))
    return out
