"""``-- @name value`` lines at the top of a query file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_LINE = re.compile(r"^\s*--\s*@([A-Za-z][\w-]*)[ \t]*(.*?)\s*$")
#: Directives that suppress one check each; a reason is mandatory.
SUPPRESSIONS = ("allow-unindexed", "allow-sort", "allow-n-plus-one", "unscoped")
_REPEATED = ("each", "type")
NAMES = ("first", "stream", "identity", "result", "params", "each", "type", "proc", "call", "mirrors", *SUPPRESSIONS)


@dataclass
class Directives:
    first: bool = False
    stream: bool = False
    identity: bool = False
    result: str | None = None
    params: dict[str, tuple[str, bool]] = field(default_factory=dict)  # name -> (database type, nullable)
    each: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)  # alias -> database type
    proc: str | None = None
    call: str | None = None
    mirrors: str | None = None
    reasons: dict[str, str] = field(default_factory=dict)
    problems: list[tuple[str, str]] = field(default_factory=list)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def split_top(text: str, sep: str = ",") -> list[str]:
    """Parts of a text at separators outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == sep and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def parse(source: str) -> tuple[Directives, str]:
    """The directives of a file and its SQL without their lines; unknown lines stay comments."""
    d, kept, seen = Directives(), [], set()
    for line in source.splitlines(keepends=True):
        m = _LINE.match(line)
        if not m:
            kept.append(line)
            continue
        name, value = m[1].lower(), m[2]
        if name not in NAMES:
            near = [k for k in NAMES if edits(name, k) <= 1]
            d.problems.append(("bad-directive", f"@{m[1]} is not a directive" + (f"; did you mean @{near[0]}?" if near else "")))
            kept.append(line)
            continue
        if name in seen and name not in _REPEATED:
            d.problems.append(("duplicate-directive", f"@{name} is given twice; the last one holds"))
        seen.add(name)
        if name in ("first", "stream", "identity"):
            setattr(d, name, True)
        elif name == "params":
            d.params = {}
            for part in split_top(value):
                key, _, kind = part.partition(":")
                d.params[key.strip().lstrip("@")] = (kind.strip().rstrip("?").strip(), kind.strip().endswith("?"))
        elif name == "each" and value:
            d.each.append(value.split()[0].lstrip("@"))
        elif name == "type" and len(value.split(None, 1)) == 2:
            alias, kind = value.split(None, 1)
            d.types[alias] = kind
        elif name == "proc":
            d.proc = value or ""
        elif name in ("result", "call", "mirrors") and value:
            setattr(d, name, value)
        elif name in SUPPRESSIONS and value:
            d.reasons[name] = value
        else:
            d.problems.append(("bad-directive", f"@{name} needs a value"))
    if d.first and d.stream or d.proc is not None and (d.stream or d.call):
        d.problems.append(("directive-conflict", "@first, @stream, @proc and @call do not go together"))
    return d, "".join(kept)
