"""python -m querywright.cli schema pull|verify, lint, impact, migrate status."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans import corpus, evolve
from .plans.catalog import QueryCatalog
from .plans.schema_checks import check_schema
from .sources.live import from_sqlite
from .sources.snapshot import infer, load_snapshot, to_json, verify


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("querywright")
    sub = p.add_subparsers(dest="verb", required=True)
    schema = sub.add_parser("schema").add_subparsers(dest="what", required=True)
    pull = schema.add_parser("pull")
    pull.add_argument("--sqlite")
    pull.add_argument("--parquet", nargs="*", default=[], metavar="TABLE=PATH")
    pull.add_argument("--out", default="-")
    check = schema.add_parser("verify")
    check.add_argument("declared")
    check.add_argument("live")
    lint = sub.add_parser("lint")
    lint.add_argument("queries")
    lint.add_argument("--schema", required=True)
    lint.add_argument("--profile", default="native", choices=["native", "strict"])
    imp = sub.add_parser("impact")
    imp.add_argument("queries")
    imp.add_argument("--schema", required=True)
    imp.add_argument("--migrations", required=True)
    mig = sub.add_parser("migrate").add_subparsers(dest="what", required=True)
    st = mig.add_parser("status")
    st.add_argument("folder")
    st.add_argument("--applied", nargs="*", default=[])
    a = p.parse_args(argv)
    if a.verb == "schema" and a.what == "pull":
        if a.sqlite:
            s = from_sqlite(a.sqlite)
        else:
            from pyspark.sql import SparkSession

            s = infer(SparkSession.builder.getOrCreate(), dict(x.split("=", 1) for x in a.parquet))
        sys.stdout.write(to_json(s) + "\n") if a.out == "-" else Path(a.out).write_text(to_json(s))
        return 0
    if a.verb == "schema":
        found = verify(load_snapshot(a.declared), load_snapshot(a.live))
        print("\n".join(f"{k}: {m}" for k, m in found) or "equal")
        return int(any(k == "breaking" for k, _ in found))
    if a.verb == "lint":
        s = load_snapshot(a.schema)
        found = check_schema(s) + corpus.lint_catalog(QueryCatalog(s, s.dialect).load(a.queries), s, a.profile)
        print("\n".join(f"{f.severity} {f.code} {f.query}: {f.message}" for f in found) or "clean")
        return int(any(f.severity == "error" for f in found))
    if a.verb == "impact":
        s = load_snapshot(a.schema)
        sim = evolve.Simulator(s)
        for f in sorted(Path(a.migrations).glob("*.sql"), key=lambda f: evolve.natural_order(f.name)):
            sim.apply(f.read_text(), f.name)
        found = evolve.impact(QueryCatalog(s, s.dialect).load(a.queries), s, sim)
        print(evolve.report(found))
        return int(any(i.level == "BREAKING" for i in found)) or 2 * int(any(f.severity == "error" for f in sim.findings))
    rows = evolve.status(a.folder, a.applied)
    print("\n".join(f"{s} {n}" for n, s in rows))
    return int(any(s != "applied" for _, s in rows))


if __name__ == "__main__":
    sys.exit(main())
