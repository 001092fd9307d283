"""Every query that has SQL agrees with DuckDB on the whole tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


def plain(v):
    """One form for numbers of any width, timestamps with and without a zone, and nested values."""
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(name, spark, duck):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    at = [names.index(c) for c in df.columns]
    rows = [tuple(r[i] for i in at) for r in want.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in rows), key=key)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
