"""Tokens, directives, rewriting, checks, tenancy, corpus checks, evolution and the table store."""

import random

import pytest

from querywright.functions.types import kind_of, literal_problem, spark_type
from querywright.operators.store import StoreError, TableStore
from querywright.plans import corpus, evolve
from querywright.plans.catalog import ParameterError, Query, QueryCatalog, ShapeError
from querywright.plans.directives import parse as directives
from querywright.plans.lexer import fingerprint, tokenize
from querywright.plans.lint import lint, result_nullability
from querywright.plans.model import parse
from querywright.plans.rewrite import rewrite
from querywright.plans.scope import ScopePolicy
from querywright.sources.snapshot import load_snapshot, to_json

SHOP = load_snapshot({
    "dialect": "postgres",
    "tables": [
        {"name": "users", "columns": [{"name": "id", "dbType": "int", "isPrimaryKey": True, "isIdentity": True, "isNullable": False}, {"name": "name", "dbType": "varchar", "maxLength": 5, "isNullable": False}, {"name": "tenant", "dbType": "int"}], "indexes": [{"name": "u", "columns": ["name"], "isUnique": True}]},
        {"name": "posts", "columns": [{"name": "id", "dbType": "int", "isPrimaryKey": True, "isNullable": False}, {"name": "user_id", "dbType": "int", "isNullable": False}, {"name": "title", "dbType": "text"}, {"name": "score", "dbType": "smallint"}, {"name": "tenant", "dbType": "int"}]},
    ],
    "foreignKeys": [{"fromTable": "posts", "fromColumn": "user_id", "toTable": "users", "toColumn": "id"}],
})


def codes(sql, profile="native", scope=None, dialect="postgres"):
    return {f.code for f in lint(Query("T.q", sql, dialect, SHOP), SHOP, profile, scope)}


def test_tokenizer_never_raises():
    rng = random.Random(0)
    parts = ["SELECT", "'a''b'", "'open", '"q"', "[x]", "`y`", "@p", "@@v", "--c\n", "/*", "*/", "0x1F", "1.5e3", "(", ")", "::", "$", "\\", "é", " ", ".", ",", ";", "N'x'"]
    for _ in range(10_000):
        sql = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        tokenize(sql)
        try:
            parse(sql)
        except (ValueError, IndexError):
            pass


def test_fingerprint():
    assert fingerprint("SELECT a -- x\nFROM T") == fingerprint("select  A from t") != fingerprint("select b from t")


@pytest.mark.parametrize("sql,dialect,want", [
    ("SELECT @a, 'C:\\', N'it''s'", "sqlserver", "SELECT :a , 'C:\\\\' , 'it\\'s'"),
    ("SELECT TOP 3 [a b] FROM t", "sqlserver", "SELECT `a b` FROM t LIMIT 3"),
    ("SELECT a FROM t ORDER BY a OFFSET 2 ROWS FETCH NEXT 3 ROWS ONLY", "sqlserver", "SELECT a FROM t ORDER BY a LIMIT 3 OFFSET 2"),
    ("SELECT CONVERT(int, x) FROM t WITH (NOLOCK)", "sqlserver", "SELECT CAST(x AS int) FROM t"),
    ("SELECT 0xFF", "native", "SELECT X'FF'"),
])
def test_rewrite(sql, dialect, want):
    assert rewrite(sql, dialect) == want


def test_directives():
    d, sql = directives("-- @first\n-- @each ids\n-- @params A:int?, B:decimal(4,2)\n-- @type n bigint\n-- @frist\n-- @allow-sort\n-- plain\nSELECT 1")
    assert d.first and d.each == ["ids"] and d.params == {"A": ("int", True), "B": ("decimal(4,2)", False)} and d.types == {"n": "bigint"}
    assert [c for c, _ in d.problems] == ["bad-directive", "bad-directive"] and "plain" in sql
    assert directives("-- @first\n-- @stream\nSELECT 1")[0].problems[0][0] == "directive-conflict"


@pytest.mark.parametrize("sql,code", [
    ("SELECT x FROM nowhere", "unknown-table"), ("SELECT nix FROM users", "unknown-column"), ("SELECT id FROM users u, posts p WHERE p.user_id = u.id", "ambiguous-column"),
    ("SELECT u.name, p.title AS name FROM users u JOIN posts p ON p.user_id = u.id", "duplicate-result"), ("SELECT upper(name) FROM users WHERE id = 1", "missing-alias"),
    ("SELECT id FROM users WHERE name = 'toolong'", "literal-length"), ("SELECT id FROM posts WHERE score = 40000", "literal-range"),
    ("SELECT p.id FROM posts p WHERE p.user_id IN (SELECT id, name FROM users)", "in-width"), ("SELECT id FROM users; SELECT id FROM posts", "multi-statement"),
    ("SELECT u.id FROM users u, posts p", "cartesian"), ("SELECT u.id FROM users u JOIN posts p ON p.id = u.id", "non-key-join"), ("SELECT id FROM users WHERE lower(name) = @n", "function-on-column"),
    ("SELECT id FROM posts WHERE title LIKE '%x'", "leading-wildcard"), ("SELECT id FROM posts WHERE title = @t", "unindexed-filter"), ("SELECT id FROM posts ORDER BY title", "unindexed-sort"),
    ("SELECT id FROM posts LIMIT 5", "unordered-page"), ("SELECT id FROM posts ORDER BY score LIMIT 5", "unstable-page"), ("SELECT id FROM users NATURAL JOIN nope", "unknown-table"), ("SELECT 'x", "unterminated"), ("SELECT $x", "bad-character"),
])
def test_fires(sql, code):
    assert code in codes(sql)


@pytest.mark.parametrize("sql", [
    "SELECT id, name FROM users WHERE id = @id", "SELECT u.name, p.title FROM users u JOIN posts p ON p.user_id = u.id WHERE u.id = @id", "SELECT id FROM posts ORDER BY id LIMIT 5",
    "SELECT count(*) AS n FROM users", "SELECT id FROM users u WHERE EXISTS (SELECT 1 FROM posts p WHERE p.user_id = u.id)",
])
def test_silent(sql):
    assert not codes(sql) - {"unindexed-filter"}


@pytest.mark.parametrize("sql,code", [("SELECT id FROM users UNION SELECT id FROM posts", "set-operation"), ("SELECT * FROM users", "star"), ("SELECT t.id FROM (SELECT id FROM users) t", "subquery-form"), ("SELECT DISTINCT ON (name) id FROM users", "no-grammar"), ("WITH RECURSIVE t AS (SELECT 1 AS n) SELECT n FROM t", "recursive"), ("SELECT lower(name) AS x FROM users", "expression-type")])
def test_strict_only(sql, code):
    assert code in codes(sql, "strict") and code not in codes(sql)


def test_nullability():
    s = parse("WITH p AS (SELECT id, user_id FROM posts) SELECT u.id, p.user_id, count(*) AS n, p.id IS NULL AS gone FROM users u LEFT JOIN p ON p.user_id = u.id GROUP BY u.id")
    assert result_nullability(s, SHOP) == {"id": False, "user_id": True, "n": False, "gone": False}


@pytest.mark.parametrize("sql,proved", [
    ("SELECT id FROM posts WHERE tenant = @t", True), ("SELECT id FROM posts WHERE tenant = @t OR id = 1", False), ("SELECT u.id FROM users u LEFT JOIN posts p ON p.user_id = u.id WHERE p.tenant = @t", False),
    ("SELECT u.id FROM users u LEFT JOIN posts p ON p.user_id = u.id AND p.tenant = @t", True), ("DELETE FROM posts WHERE id = @i", False), ("INSERT INTO posts (id, tenant) VALUES (@i, @t)", True), ("INSERT INTO posts (id, tenant) VALUES (@i, 4)", False),
])
def test_scope(sql, proved):
    policy = ScopePolicy.load('{"scopes": [{"table": "posts", "column": "tenant"}]}', SHOP)
    assert ("unscoped-reach" not in codes(sql, scope=policy)) == proved


def test_corpus_checks():
    c = QueryCatalog(SHOP, "postgres")
    c.add("Users.All", "SELECT id, name FROM users")
    c.add("Posts.OfUser", "SELECT id, title FROM posts WHERE user_id = @u")
    c.add("Posts.Same", "select ID, title from posts where user_id = @u")
    c.add("Posts.Page", "-- @mirrors Posts.Count\nSELECT p.id FROM posts p WHERE p.title = @t")
    c.add("Posts.Count", "SELECT count(*) AS n FROM posts WHERE title = @t AND score > @s")
    assert [f.query for f in corpus.duplicates(c)] == ["Posts.Same"]
    assert {f.query for f in corpus.n_plus_one(c, SHOP)} == {"Posts.OfUser", "Posts.Same"}
    assert [f.code for f in corpus.drift(c, SHOP)] == ["predicate-drift"]


def test_evolution():
    sim = evolve.Simulator(SHOP).apply("ALTER TABLE posts ADD COLUMN body text NOT NULL; ALTER TABLE users DROP COLUMN name; ALTER TABLE posts ALTER COLUMN score TYPE bigint; CREATE TABLE tags (id int PRIMARY KEY, post_id int REFERENCES posts(id)); DROP TABLE nix; CREATE POLICY x ON posts")
    kinds = {(c.kind, c.table, c.column) for c in evolve.diff(SHOP, sim.snapshot)}
    assert kinds == {("column-added", "posts", "body"), ("column-removed", "users", "name"), ("widened", "posts", "score"), ("table-added", "tags", "")}
    assert [f.code for f in sim.findings] == ["invalid-migration", "not-simulated"]
    c = QueryCatalog(SHOP, "postgres")
    c.add("A.a", "SELECT name FROM users")
    c.add("A.b", "SELECT score FROM posts WHERE id = @i")
    c.add("A.c", "SELECT id FROM users")
    levels = {i.query: i.level for i in evolve.impact(c, SHOP, sim)}
    assert levels == {"A.a": "BREAKING", "A.b": "RISKY", "A.c": "SAFE"}
    assert evolve.read_report(evolve.report(evolve.impact(c, SHOP, sim))) == evolve.impact(c, SHOP, sim)
    assert sorted(["10_a.sql", "2_b.sql"], key=evolve.natural_order) == ["2_b.sql", "10_a.sql"]


def test_snapshot_round_trip():
    assert load_snapshot(to_json(SHOP)) == SHOP


def test_types():
    assert spark_type("numeric(5,2)").simpleString() == "decimal(5,2)" and spark_type("int[]").simpleString() == "array<int>"
    assert kind_of("tinyint(1)", "mysql") == "boolean" and kind_of("timestamp", "sqlserver") == "version" and spark_type("hierarchyid") is None
    assert literal_problem("256", False, "tinyint", "sqlserver")[0] == "literal-range" and literal_problem("1.234", False, "decimal(5,2)", "postgres")


def test_shapes(spark):
    with pytest.raises(ShapeError):
        Query("q", "-- @type n int\nSELECT count(*) AS n FROM range(3)")(spark)
    with pytest.raises(ParameterError):
        Query("q", "SELECT @a AS x")(spark)
    q = Query("q", "-- @params n:bigint\nSELECT id FROM range(10) WHERE id > @n")
    assert [r["id"] for r in q.stream(spark, n=7)] == [8, 9] and q.first(spark, n=20) is None
    with pytest.raises(ParameterError):
        q(spark, n="x")


def test_store(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"), SHOP)
    schema = "id int, name string, tenant int"
    s.write("users", spark.createDataFrame([(1, "ann", 1), (2, "bob", 2)], schema))
    assert s.insert("users", [{"name": "cy", "tenant": 1}, {"name": "di", "tenant": 2}]) == [3, 4]
    assert s.update("users", {"id": 2}, {"name": "rob"}) == 1 and s.update("users", {"id": 99}, {"name": "x"}) == 0
    with pytest.raises(RuntimeError), s.transaction():
        s.delete("users", {"id": 1})
        raise RuntimeError("stop")
    assert s.read("users").count() == 4
    assert s.delete("users", {"id": 1}, {"tenant": 2}) == 0 and s.delete("users", {"id": 1}) == 1
    assert sorted(r["name"] for r in s.read("users").collect()) == ["cy", "di", "rob"]
    assert [s.next_value("n"), s.next_value("n")] == [1, 2]
    other = TableStore(spark, str(tmp_path / "store"), SHOP)
    with s.transaction(), pytest.raises(StoreError):
        other.delete("users", {"id": 2})


@pytest.mark.parametrize(
    ("sql", "dialect", "want"),
    [
        ("SELECT a / 2, 1.5 * a / 2, (a + 1) / b, s / 2 FROM t", "postgres", "SELECT a div 2 , 1.5 * a / 2 , ( a + 1 ) div b , s / 2 FROM t"),
        ("SELECT s + ' ' + s, a + 1 FROM t", "sqlserver", "SELECT s || ' ' || s , a + 1 FROM t"),
        ("SELECT coalesce(a, b) AT TIME ZONE 'CET' FROM t", "postgres", "SELECT from_utc_timestamp(coalesce ( a , b ), 'CET') FROM t"),
        ("SELECT a FROM t ORDER BY a OFFSET 5 ROWS", "sqlserver", "SELECT a FROM t ORDER BY a OFFSET 5"),
        ("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST, c LIMIT 3", "postgres", "SELECT a FROM t ORDER BY a DESC NULLS FIRST , b NULLS FIRST , c NULLS LAST LIMIT 3"),
        ("SELECT DATE_ADD(d, INTERVAL 2 MONTH) FROM t", "mysql", "SELECT (d + (2) * INTERVAL 1 MONTH) FROM t"),
    ],
)
def test_rewrite_by_kind(sql, dialect, want):
    assert rewrite(sql, dialect, frozenset(), {"a": "whole", "b": "whole", "s": "text"}) == want


def test_top_with_ties_in_any_place(spark):
    """The list may hold a FROM of its own; nulls and falling orders tie as others do."""
    spark.createDataFrame([(1, "2020-01-01"), (2, "2021-01-01"), (2, "2022-01-01"), (None, "2023-01-01")], "a int, d string").createOrReplaceTempView("ties")
    for way, want in (("DESC", [2, 2]), ("", [None])):
        sql = rewrite(f"SELECT TOP 1 WITH TIES a, extract(YEAR FROM CAST(d AS date)) AS y FROM ties WHERE a > 0 OR a IS NULL ORDER BY a {way}", "sqlserver")
        assert [r["a"] for r in spark.sql(sql).collect()] == want
    assert [r["a"] for r in spark.sql(rewrite("SELECT TOP 50 PERCENT a FROM ties ORDER BY a DESC", "sqlserver")).collect()] == [2, 2]


def written(spark, path):
    from querywright.operators.store import TableStore
    from querywright.sources.snapshot import Column, Snapshot, Table

    s = Snapshot("postgres")
    s.tables.append(Table("people", [Column("id", "int", False, True, is_identity=True), Column("name", "text", True)]))
    s.tables.append(Table("stock", [Column("sku", "text", False, True), Column("n", "int", True)]))
    store = TableStore(spark, str(path), s)
    store.write("people", spark.createDataFrame([(1, "bo")], "id int, name string"))
    store.write("stock", spark.createDataFrame([("a", 1), ("b", 2)], "sku string, n int"))
    return s, store


def test_written_statements(spark, tmp_path):
    from querywright.plans.catalog import Query, ShapeError

    s, store = written(spark, tmp_path)
    run = lambda sql, **a: Query("q", sql, "postgres", s).execute(store, **a)
    rows = lambda t: sorted(map(tuple, store.read(t).collect()), key=str)
    assert run("-- @identity\nINSERT INTO people (name) VALUES (@A), ('amy')", A="zed") == [2, 3]
    assert rows("people") == [(1, "bo"), (2, "zed"), (3, "amy")]
    assert run("UPDATE stock SET n = n * 2 WHERE sku = @K", K="b") == 1 and run("UPDATE stock SET n = 0 WHERE sku = 'none'") == 0
    got = run("INSERT INTO stock VALUES ('b', 5), ('c', 6) ON CONFLICT (sku) DO UPDATE SET n = stock.n + excluded.n RETURNING sku, n")
    assert sorted(map(tuple, got.collect())) == [("b", 9), ("c", 6)]
    assert run("DELETE FROM stock WHERE n > 8") == 1 and rows("stock") == [("a", 1), ("c", 6)]
    with pytest.raises(Exception):
        run("UPDATE people SET id = 9")
    with pytest.raises(ShapeError):
        Query("q", "DELETE FROM stock", "postgres", s)(spark)


def test_ids_belong_to_their_rows(spark, tmp_path):
    _, store = written(spark, tmp_path)
    assert store.insert("people", [{"name": "zed"}, {"name": "amy"}]) == [2, 3]
    many = spark.range(0, 1000, 1, 7).selectExpr("cast(id AS string) AS name", "0 AS id")
    assert store.insert("people", many) == 1000
    assert {r["name"]: r["id"] for r in store.read("people").collect()} == {"bo": 1, "zed": 2, "amy": 3} | {str(k): k + 4 for k in range(1000)}


def test_manifest_is_never_missing(spark, tmp_path):
    """A writer that dies before its rename leaves the last state; its lock can be broken."""
    _, store = written(spark, tmp_path)
    with pytest.raises(ZeroDivisionError), store.transaction():
        store.write("stock", store.read("stock").limit(0))
        raise ZeroDivisionError
    assert store.read("stock").count() == 2
    (tmp_path / "lock").touch()
    with pytest.raises(Exception):
        store.delete("stock", {"sku": "a"})
    store.break_lock()
    assert store.delete("stock", {"sku": "a"}) == 1 and len(list(tmp_path.glob("manifest-*"))) == 2


def test_many_values_are_checked_as_few(spark):
    from querywright.plans.catalog import ParameterError, Query
    from querywright.sources.snapshot import Column, Snapshot, Table

    s = Snapshot("postgres")
    s.tables.append(Table("words", [Column("w", "varchar", True)]))
    q = Query("q", "-- @each W\nSELECT w FROM words WHERE w IN (@W)", "postgres", s)
    for n in (3, 1500):
        with pytest.raises(ParameterError):
            q(spark, W=list(range(n)))


def test_last_row_of_a_frame_wins(spark):
    from querywright.operators import crud
    from querywright.sources.snapshot import Column, Table

    t = Table("stock", [Column("sku", "text", False, True), Column("n", "int", True)])
    base = spark.createDataFrame([("a", 1)], "sku string, n int")
    rows = [("a", 2), ("b", 3), (None, 4), ("a", None), (None, 5)]
    want = [("a", None), ("b", 3), (None, 4), (None, 5)]
    for given in (spark.createDataFrame(rows, "sku string, n int").coalesce(1), [{"sku": a, "n": b} for a, b in rows]):
        try:
            got = crud.upsert(base, t, given)
        except crud.CrudError:
            got = None  # plain rows are guarded: the key may not be null
        assert got is None or sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_lazy_rows_are_all_rows(spark, data):
    from querywright.streaming.rows import lazy_rows, repeatable

    lines = spark.read.parquet(f"{data}/lineitem.parquet").where("l_quantity > 3").select("l_orderkey", "l_linenumber")
    whole = lines.collect()
    assert repeatable(lines) and len(whole) > 1000
    for head in (0, 10, 1000, len(whole), len(whole) + 1):
        assert list(lazy_rows(lines, head=head)) == whole
    moved = lines.groupBy("l_orderkey").count()
    assert not repeatable(moved) and sorted(lazy_rows(moved)) == sorted(moved.collect())


def test_schema_findings():
    from querywright.plans.schema_checks import accessor, check_schema
    from querywright.sources.snapshot import Column, Enum, Function, Index, Param, Procedure, Sequence, Snapshot, Table, UserType

    s = Snapshot("postgres")
    assert [f.code for f in check_schema(s)] == ["no-schema"]
    s.tables += [
        Table("empty"),
        Table("people", [Column("id", "int", False, True), Column("mail", "text"), Column("user name", "text"), Column("UserName", "text")], [Index("mails", ["mail"], True), Index("starts", ["mail"], True, has_prefix_keys=True), Index("lower", [], True, has_expression_keys=True)]),
    ]
    s.sequences += [Sequence("OrderIds"), Sequence("order_ids")]
    s.enums.append(Enum("mood", ["so-so", "so so", "!!"]))
    s.user_types.append(UserType("id_list", "TableType"))
    s.functions += [Function("f", "int", [Param("a", "int")]), Function("F", "int", [Param("b", "text")]), Function("g", "hyperspace", [Param("a", "id_list")])]
    s.procedures.append(Procedure("p", [Param("rows", "ID_LIST")]))
    found = [f.code for f in check_schema(s)]
    want = {"table-skipped": 1, "prefix-key": 1, "expression-key": 1, "non-atomic-upsert": 1, "lossy-rename": 1, "sequence-duplicate": 1, "enum-member": 2, "function-collision": 1, "table-parameter": 2, "function-unmappable": 1}
    assert {c: found.count(c) for c in want} == want and len(found) == sum(want.values())
    assert accessor("dbo.GetAll Rows") == "get_all_rows" and accessor("class") == "class_" and accessor("2nd") == "_2nd"
