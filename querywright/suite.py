"""The registered queries: each through the catalog (directives, parameters, rewriting), with the SQL
that DuckDB must agree with.  Both sides end paged orders in a unique key and sum whole cents."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import crud
from .plans.catalog import Query, QueryCatalog
from .plans.lexer import tokenize
from .sources.live import forget, register
from .sources.snapshot import Snapshot, load_snapshot

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ROOT = Path(__file__).resolve().parent


@lru_cache(maxsize=1)
def snapshot() -> Snapshot:
    return load_snapshot(ROOT / "schema" / "driver.schema.json")


@lru_cache(maxsize=1)
def catalog() -> QueryCatalog:
    return QueryCatalog(snapshot()).load(str(ROOT / "queries"))


_SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_DUCK: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_literal, v)) or "NULL"
    return str(v)


def _in(spark: SparkSession, sf_dir: str, q: Query | None = None) -> None:
    """Views of the tables that a statement names, or of all."""
    words = {t.value.lower() for t in tokenize(q.sql)} if q else set(TABLES)
    register(spark, sf_dir, [t for t in TABLES if t in words])


def query(name: str, sql: str, duck: str | None = None, dialect: str = "native", **args) -> None:
    q = Query(name, sql, dialect, snapshot())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _in(spark, sf_dir, q)
        return q(spark, **args)

    _SPARK[name] = run
    text = duck or q.sql
    for k in sorted(args, key=len, reverse=True):
        text = re.sub(rf"@{k}\b", lambda m, k=k: _literal(args[k]), text)
    _DUCK[name] = text.strip().rstrip(";")


def frame(name: str, duck: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _SPARK[name] = f
        _DUCK[name] = duck
        return f

    return add


# Scans, views and projection
query("scan_get_all", "SELECT r_regionkey, r_name FROM region")
query("scan_table_hint", "SELECT n_nationkey, n_name FROM nation WITH (NOLOCK)", "SELECT n_nationkey, n_name FROM nation", dialect="sqlserver")
query("scan_schema_qualified", "SELECT c.c_custkey, c.c_name FROM dbo.customer c WHERE c.c_custkey <= 50", "SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey <= 50", dialect="sqlserver")
query("project_alias", "SELECT c_custkey AS id, c_name AS full_name FROM customer")
query("project_quoted", 'SELECT [c_custkey] AS [the key], `c_name` AS `n`, "c_mktsegment" AS "seg" FROM customer', 'SELECT c_custkey AS "the key", c_name AS n, c_mktsegment AS seg FROM customer')
query("project_expr_concat", "SELECT p_partkey, p_name || ' / ' || p_brand AS label, upper(p_type) AS kind, lower(p_brand) AS brand, left(p_name, 4) AS head, right(p_name, 3) AS tail FROM part")
query("project_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM orders")
query("project_cast", "SELECT o_orderkey, CAST(o_orderkey AS varchar(20)) AS as_text, CAST(o_totalprice AS decimal(12,2)) AS price, CAST(o_orderdate AS date) AS day FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS varchar) AS as_text, CAST(o_totalprice AS decimal(12,2)) AS price, CAST(o_orderdate AS date) AS day FROM orders")
query("project_convert", "SELECT p_partkey, CONVERT(bigint, p_size) AS wide FROM part", "SELECT p_partkey, CAST(p_size AS bigint) AS wide FROM part", dialect="sqlserver")
query("project_colon_cast", "SELECT p_partkey, p_size::bigint AS wide FROM part")
query("project_coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS region FROM nation")
query("project_round", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 2, 0) AS bigint) AS twice, CAST(l_quantity AS bigint) % 7 AS rest FROM lineitem")
query("project_newline_literal", "SELECT n_nationkey, 'a\nb''c\\d' || n_name AS label FROM nation")
query("project_exists", "SELECT c.c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AS rich FROM customer c")
query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
query("math_operators", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 3 AS c, 7 / 2 AS d FROM part", "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS b, p_size * 3 AS c, CAST(7 // 2 AS bigint) AS d FROM part", dialect="postgres")

# Predicates and parameters
query("filter_comparisons", "SELECT o_orderkey FROM orders WHERE o_totalprice >= @low AND o_totalprice < @high AND @status <> o_orderstatus", low=50000.0, high=150000.0, status="P")
query("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN @a AND @b", a=10, b=20)
query("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE @pattern", pattern="%00001%")
query("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
query("filter_is_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL")
query("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority LIKE '1%'")
query("filter_optional_set", "SELECT c_custkey FROM customer WHERE (@segment IS NULL OR c_mktsegment = @segment) AND (@nation IS NULL OR c_nationkey = @nation)", segment="BUILDING", nation=None, duck="SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
query("filter_optional_unset", "SELECT c_custkey FROM customer WHERE (@segment IS NULL OR c_mktsegment = @segment)", segment=None, duck="SELECT c_custkey FROM customer")
query("each_ids", "-- @each ids\nSELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (@ids)", ids=[1, 5, 8, 13, 400])
query("each_many", "-- @each ids\nSELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (@ids)", ids=list(range(1, 3000, 2)), duck="SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1 AND o_custkey < 3000")
query("each_empty", "-- @each ids\nSELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (@ids)", ids=[], duck="SELECT o_orderkey, o_custkey FROM orders WHERE false")
query("first_by_key", "-- @first\nSELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = @id", id=42)
query("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = @nation)", nation=3)
query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
query("exists_correlated", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
query("not_exists", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
query("exists_under_or", "SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)")

# Joins
query("join_inner_multi", "SELECT r.r_name, n.n_name, count(*) AS customers FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey INNER JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name")
query("join_left", "SELECT d.lang, count(*) AS documents, count(l.doc_id) AS labelled FROM documents d LEFT OUTER JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
query("join_right", "SELECT d.doc_id, l.quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
query("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 9) b ON a.n_nationkey = b.n_nationkey")
query("join_cross", "SELECT r.r_name, s.o_orderstatus FROM region r CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s")
query("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
query("join_using", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
query("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels")
query("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
query("join_theta_residual", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal + 5000")
query("join_composite", "SELECT a.conv_id, a.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")

# Aggregation
query("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS bigint)) AS cents FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS bigint)) AS bigint) AS cents FROM lineitem GROUP BY l_returnflag, l_linestatus")
query("agg_ordinals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2")
query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus")
query("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
query("agg_bool_or", "SELECT c_nationkey, bool_or(c_acctbal < 0) AS any_debt, bool_and(c_acctbal > 0) AS all_paid FROM customer GROUP BY c_nationkey")
query("agg_min_max_avg", "SELECT p_brand, min(p_size) AS low, max(p_size) AS high, round(avg(p_size), 4) AS mid FROM part GROUP BY p_brand")
query("agg_expr_sum", "SELECT l_suppkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS bigint)) AS revenue FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS bigint)) AS bigint) AS revenue FROM lineitem GROUP BY l_suppkey")
query("agg_count_gt_zero", "SELECT c_mktsegment, count(*) > 0 AS has_any FROM customer GROUP BY c_mktsegment")
query("agg_empty_sum", "SELECT sum(p_size) AS total, count(*) AS n FROM part WHERE p_size < 0", "SELECT CAST(sum(p_size) AS bigint) AS total, count(*) AS n FROM part WHERE p_size < 0")
query("agg_decimal", "SELECT o_orderstatus, sum(CAST(o_totalprice AS decimal(12,2))) AS total FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS decimal(12,2))) AS decimal(22,2)) AS total FROM orders GROUP BY o_orderstatus")

# Windows
query("win_count_over", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
query("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS r FROM orders")
query("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS bigint) AS d FROM part")
query("win_running_sum", "SELECT o_orderkey, sum(CAST(round(o_totalprice * 100) AS bigint)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM orders", "SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS bigint)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS running FROM orders")
query("win_named", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")

# Order, limits, CTEs
query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
query("page_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT @take OFFSET @skip", take=25, skip=100)
query("page_past_end", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT @take OFFSET @skip", take=10, skip=50)
query("fetch_next", "SELECT p_partkey FROM part ORDER BY p_partkey OFFSET 40 ROWS FETCH NEXT 10 ROWS ONLY", dialect="sqlserver")
query("top_n", "SELECT TOP (7) o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7", dialect="sqlserver")
query("top_with_ties", "SELECT TOP 5 WITH TIES p_partkey, p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5", dialect="sqlserver")
query("top_percent", "SELECT TOP 10 PERCENT s_suppkey, s_name FROM supplier ORDER BY s_suppkey", "SELECT s_suppkey, s_name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS r, count(*) OVER () AS n FROM supplier) WHERE r <= ceil(n * 10 / 100.0)", dialect="sqlserver")
query("cte_chain", "WITH big (k, c, p) AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 250000), per AS (SELECT c, count(*) AS n FROM big GROUP BY c) SELECT cu.c_custkey, per.n FROM per JOIN customer cu ON cu.c_custkey = per.c")
query("cte_left_join", "WITH urgent AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) SELECT c.c_custkey, u.n FROM customer c LEFT JOIN urgent u ON u.o_custkey = c.c_custkey")

# Dates
query("date_extract_month", "SELECT extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate AT TIME ZONE 'UTC') AS m, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS integer) AS y, CAST(month(o_orderdate) AS integer) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
query("date_strftime", "SELECT o_orderkey, strftime('%Y-%m', o_orderdate) AS month FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders", dialect="sqlite")
query("date_diff_avg_days", "SELECT o.o_orderstatus, sum(timestampdiff(DAY, o.o_orderdate, l.l_shipdate)) AS days, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus", "SELECT o.o_orderstatus, CAST(sum(trunc(date_diff('microsecond', o.o_orderdate, l.l_shipdate) / 86400000000.0)) AS bigint) AS days, count(*) AS n FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderstatus")
query("date_julian", "SELECT o_orderkey, CAST(julianday(o_orderdate) - julianday('2000-01-01') AS bigint) AS days FROM orders", "SELECT o_orderkey, CAST(trunc(date_diff('microsecond', TIMESTAMP '2000-01-01', o_orderdate) / 86400000000.0) AS bigint) AS days FROM orders", dialect="sqlite")
query("date_add_month", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS date) AS due FROM orders")

# Refused by the strict profile, run by the native one
query("set_union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
query("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("set_except", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
query("derived_table", "SELECT t.c_nationkey, t.n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) t WHERE t.n > 50")
query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
query("lateral", "SELECT n.n_name, x.top_balance FROM nation n, LATERAL (SELECT max(c.c_acctbal) AS top_balance FROM customer c WHERE c.c_nationkey = n.n_nationkey) x")
query("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 30) SELECT n FROM t")
query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
query("json_prop", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
query("array_filter", "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS bigint) AS positive FROM embeddings", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS bigint) AS positive FROM embeddings")


# Synthesized operations as transformations of a base frame
def _base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _table(name: str):
    return snapshot().table(name)


@frame("crud_get_by_id", "SELECT * FROM customer WHERE c_custkey = 17")
def _(spark, d):
    return crud.get_by_id(_base(spark, d, "customer"), _table("customer"), {"c_custkey": 17})


@frame("crud_get_by_composite_id", "SELECT * FROM conversations WHERE conv_id = 3 AND turn = 1")
def _(spark, d):
    return crud.get_by_id(_base(spark, d, "conversations"), _table("conversations"), {"conv_id": 3, "turn": 1})


@frame("crud_get_by_fk", "SELECT * FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    return crud.loaders(snapshot(), "nation")["get_by_n_regionkey"](_base(spark, d, "nation"), 2)


@frame("crud_insert", "SELECT * FROM nation UNION ALL SELECT CAST(25 AS integer), 'ATLANTIS', CAST(1 AS integer)")
def _(spark, d):
    return crud.insert(_base(spark, d, "nation"), _table("nation"), [{"n_nationkey": 25, "n_name": "ATLANTIS", "n_regionkey": 1}])


@frame("insert_select", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0")
def _(spark, d):
    rows = _base(spark, d, "nation").where("n_regionkey = 0").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return crud.insert(_base(spark, d, "region"), _table("region"), rows)


@frame("crud_update", "SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'RENAMED' ELSE c_name END AS c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey = 5 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, d):
    return crud.update(_base(spark, d, "customer"), _table("customer"), {"c_custkey": 5}, {"c_name": "RENAMED", "c_mktsegment": "NONE"})[0]


@frame("crud_delete", "SELECT * FROM nation WHERE n_nationkey <> 7")
def _(spark, d):
    return crud.delete(_base(spark, d, "nation"), _table("nation"), {"n_nationkey": 7})[0]


@frame("delete_where_nulls_stay", "SELECT n_nationkey FROM nation WHERE NOT coalesce(nullif(n_regionkey, 1) > 2, false)")
def _(spark, d):
    return crud.delete_where(_base(spark, d, "nation"), F.expr("nullif(n_regionkey, 1) > 2")).select("n_nationkey")


@frame("crud_upsert", "SELECT * FROM nation WHERE n_nationkey NOT IN (3, 40) UNION ALL SELECT CAST(3 AS integer), 'THREE', CAST(0 AS integer) UNION ALL SELECT CAST(40 AS integer), 'FORTY', CAST(4 AS integer)")
def _(spark, d):
    rows = [{"n_nationkey": 3, "n_name": "FIRST", "n_regionkey": 9}, {"n_nationkey": 40, "n_name": "FORTY", "n_regionkey": 4}, {"n_nationkey": 3, "n_name": "THREE", "n_regionkey": 0}]
    return crud.upsert(_base(spark, d, "nation"), _table("nation"), rows)


@frame("upsert_do_nothing", "SELECT * FROM nation UNION ALL SELECT CAST(40 AS integer), 'FORTY', CAST(4 AS integer)")
def _(spark, d):
    rows = [{"n_nationkey": 3, "n_name": "THREE", "n_regionkey": 0}, {"n_nationkey": 40, "n_name": "FORTY", "n_regionkey": 4}]
    return crud.upsert(_base(spark, d, "nation"), _table("nation"), rows, on_match="nothing")


@frame("bulk_insert", "SELECT * FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def _(spark, d):
    base = _base(spark, d, "customer")
    return crud.insert(base, _table("customer"), base.where("c_acctbal > 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))


@frame("identity_insert", "SELECT CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY n_nationkey) AS bigint) AS id, n_name FROM nation")
def _(spark, d):
    rows = _base(spark, d, "nation").select("n_nationkey", "n_name")
    return crud.with_identity(rows, "id", _base(spark, d, "customer").agg(F.max("c_custkey")).first()[0], ["n_nationkey"]).select("id", "n_name")


@frame("rowversion_stale", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 1 THEN 2 ELSE 1 END AS version FROM nation")
def _(spark, d):
    base = _base(spark, d, "nation").select("n_nationkey", "n_name", F.lit(1).alias("version"))
    base, hit = crud.versioned_update(base, {"n_nationkey": 1}, {}, "version", 1)
    base, stale = crud.versioned_update(base, {"n_nationkey": 2}, {"n_name": "LOST"}, "version", 99)
    return base


@frame("scoped_get_all", "SELECT * FROM customer WHERE c_nationkey = 4")
def _(spark, d):
    return crud.scoped(_base(spark, d, "customer"), {"c_nationkey": 4})


@frame("scoped_update", "SELECT c_custkey, CASE WHEN c_custkey = 5 AND c_nationkey = 4 THEN 'SCOPED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def _(spark, d):
    return crud.update(_base(spark, d, "customer"), _table("customer"), {"c_custkey": 5}, {"c_mktsegment": "SCOPED"}, scope={"c_nationkey": 4})[0].select("c_custkey", "c_mktsegment")


@frame("update_from_join", "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) r ON r_regionkey = n_regionkey")
def _(spark, d):
    region = _base(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"))
    return crud.update_from(_base(spark, d, "nation"), region, ["n_regionkey"], ["n_name"])


@frame("sql_function_call", "SELECT p_partkey, p_size * 2 + 1 AS doubled FROM part")
def _(spark, d):
    _in(spark, d)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION qw_double(x INT) RETURNS INT RETURN x * 2 + 1")
    return spark.sql("SELECT p_partkey, qw_double(p_size) AS doubled FROM part")


def _file(name: str, key: str, **args) -> None:
    q = catalog()[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _in(spark, sf_dir, q)
        return q(spark, **args)

    _SPARK[key] = run
    text = re.sub(r"--.*", "", q.sql)
    for k in sorted(args, key=len, reverse=True):
        text = re.sub(rf"@{k}\b", lambda m, k=k: _literal(args[k]), text)
    _DUCK[key] = re.sub(r"\bAS total_spend\b", "AS total_spend", text).strip().rstrip(";")


_file("Customer.GetTopBySpend", "topk_spend", MinPrice=1000.0)
_file("Orders.GetRevenueByRegion", "topk_revenue")
_file("Customer.GetPage", "page_file", Segment="BUILDING", Skip=10, Take=15)


def write(name: str, sql: str, duck: str, dialect: str = "native", rows: bool = False, **args) -> None:
    """A writing statement: the content of its table afterwards, or with ``rows`` what it returns."""
    q = Query(name, sql, dialect, snapshot())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        change = q.change(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"), **args)
        # The views of a statement are its own.
        forget()
        return change.rows if rows else change.content

    _SPARK[name] = run
    _DUCK[name] = duck


_NATION = "n_nationkey, n_name, n_regionkey"
write("write_insert_values", "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (@Id, 'ATLANTIS', 1), (41, @Name, NULL)", f"SELECT {_NATION} FROM nation UNION ALL SELECT 40, 'ATLANTIS', 1 UNION ALL SELECT 41, 'MU', NULL", Id=40, Name="MU")
write("write_insert_select", "INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = @R", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2", R=2)
write("write_update", "UPDATE customer SET c_acctbal = c_acctbal + 10, c_mktsegment = @Seg WHERE c_nationkey = 3 AND c_acctbal < 0", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 AND c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer", Seg="NEW")
write("write_update_from", "UPDATE nation SET n_name = r.r_name FROM region r WHERE nation.n_regionkey = r.r_regionkey AND r.r_regionkey < 2", "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 2) r ON r_regionkey = n_regionkey", dialect="postgres")
write("write_delete", "DELETE FROM nation WHERE nullif(n_regionkey, 1) > 2", f"SELECT {_NATION} FROM nation WHERE NOT coalesce(nullif(n_regionkey, 1) > 2, false)")
write("write_delete_subquery", "DELETE FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", "SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
write("write_on_conflict_update", "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (3, 'FIRST', 9), (40, 'FORTY', 4), (3, 'THREE', 0), (5, 'FIVE', 0) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name || '/' || nation.n_name WHERE nation.n_nationkey < 5", f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE/' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 40, 'FORTY', 4", dialect="postgres")
write("write_on_conflict_nothing", "INSERT INTO nation VALUES (3, 'THREE', 0), (40, 'FORTY', 4) ON CONFLICT DO NOTHING", f"SELECT {_NATION} FROM nation UNION ALL SELECT 40, 'FORTY', 4", dialect="sqlite")
write("write_on_duplicate_key", "INSERT INTO nation VALUES (3, 'THREE', 0), (40, 'FORTY', 4) ON DUPLICATE KEY UPDATE n_name = VALUES(n_name)", f"SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'THREE' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 40, 'FORTY', 4", dialect="mysql")
write("returning_update", "UPDATE nation SET n_regionkey = n_regionkey + 1 WHERE n_nationkey < 4 RETURNING n_nationkey AS id, n_regionkey * 10 AS tens", "SELECT n_nationkey AS id, (n_regionkey + 1) * 10 AS tens FROM nation WHERE n_nationkey < 4", dialect="postgres", rows=True)
write("returning_delete", "DELETE FROM nation WHERE n_regionkey = 1 RETURNING *", f"SELECT {_NATION} FROM nation WHERE n_regionkey = 1", dialect="postgres", rows=True)
write("returning_upsert", "INSERT INTO nation VALUES (3, 'THREE', 0), (40, 'FORTY', 4) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name RETURNING n_nationkey, n_name", "SELECT 3 AS n_nationkey, 'THREE' AS n_name UNION ALL SELECT 40, 'FORTY'", dialect="postgres", rows=True)
# Dialects
query("dialect_whole_division", "SELECT p_partkey, p_size / 3 AS third, (p_size + 1) / 2 AS half, 1.5 * p_size / 2 AS wide FROM part", "SELECT p_partkey, p_size // 3 AS third, (p_size + 1) // 2 AS half, 1.5 * p_size / 2 AS wide FROM part", dialect="postgres")
query("dialect_text_plus", "SELECT p_partkey, p_name + ' / ' + p_brand AS label, p_size + 1 AS more FROM part", "SELECT p_partkey, p_name || ' / ' || p_brand AS label, p_size + 1 AS more FROM part", dialect="sqlserver")
query("dialect_null_order", "SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation ORDER BY nullif(n_regionkey, 1) DESC, n_nationkey LIMIT 7", "SELECT n_nationkey, nullif(n_regionkey, 1) AS r FROM nation ORDER BY nullif(n_regionkey, 1) DESC NULLS FIRST, n_nationkey LIMIT 7", dialect="postgres")
query("dialect_distinct_on", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey", dialect="postgres")
query("dialect_offset_rows", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 5 ROWS", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 5", dialect="sqlserver")
query("dialect_top_ties", "SELECT TOP (3) WITH TIES n_nationkey, extract(YEAR FROM DATE '2020-05-01') AS y, n_regionkey FROM nation ORDER BY n_regionkey DESC", "SELECT n_nationkey, 2020 AS y, n_regionkey FROM nation WHERE n_regionkey >= (SELECT n_regionkey FROM nation ORDER BY n_regionkey DESC LIMIT 1 OFFSET 2)", dialect="sqlserver")
query("dialect_time_zone", "SELECT o_orderkey, coalesce(CAST(o_orderdate AS timestamp), CAST('2020-01-01' AS timestamp)) AT TIME ZONE 'UTC' AS t FROM orders WHERE o_orderkey < 100", "SELECT o_orderkey, CAST(o_orderdate AS timestamp) AS t FROM orders WHERE o_orderkey < 100", dialect="postgres")
query("dialect_date_add", "SELECT o_orderkey, CAST(DATE_ADD(o_orderdate, INTERVAL 2 MONTH) AS date) AS later FROM orders", "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 2 MONTH AS date) AS later FROM orders", dialect="mysql")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(_DUCK)
