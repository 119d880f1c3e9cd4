"""Registered queries: dialect text through the engine, each with SQL that another engine can check it by."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspan.results import batches
from larkspan.session import Database
from larkspan.sources.admin import Admin
from larkspan.sources.files import ParquetTables
from larkspan.sources.fs import files_of, new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _views(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    def orders_n() -> DataFrame:
        """Orders with NULLs: the tables have none."""
        o = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return o.select("o_orderkey", F.expr("nullif(o_custkey % 5, 0)").alias("k"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"), (F.col("o_orderkey") % 7).alias("m"))

    return {"orders_n": orders_n}


_ORDERS_N = "(SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k, nullif(o_orderpriority, '5-LOW') AS p, o_orderkey % 7 AS m FROM orders)"


def tables(spark: SparkSession, sf_dir: str) -> ParquetTables:
    return ParquetTables(spark, sf_dir, _views(spark, sf_dir))


def _sql(key: str, text: str, oracle: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: tables(spark, sf_dir).query(text)
    ORACLES[key] = oracle.replace("orders_n", _ORDERS_N)


def _query(oracle: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return register


def database(spark: SparkSession, **options) -> Database:
    """A new database in a folder that goes with the application."""
    base = new_folder(spark)
    if options.pop("replica", False):
        options["replica_dir"] = f"{base}/replica"
    return Database.create(spark, f"{base}/db", **options)


# projection

_sql("scan_star", "SELECT * FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
_sql("project_cols", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, c_name FROM customer")
_sql("project_expr", "SELECT c_custkey, c_nationkey * 2 + 1 FROM customer", 'SELECT c_custkey, CAST(c_nationkey AS BIGINT) * 2 + 1 AS "((c_nationkey * 2) + 1)" FROM customer')
_sql("project_literal", "SELECT 1, 'x', NULL AS n, r_name FROM region", "SELECT CAST(1 AS BIGINT) AS \"1\", 'x' AS \"'x'\", CAST(NULL AS BIGINT) AS n, r_name FROM region")
_sql("project_bool_int", "SELECT p_partkey, p_size > 25 AS big, NOT p_size > 25 AS small FROM part", "SELECT p_partkey, CAST(p_size > 25 AS BIGINT) AS big, CAST(NOT p_size > 25 AS BIGINT) AS small FROM part")

# predicates

for _key, _op in (("eq", "="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _sql(f"filter_cmp_{_key}", f"SELECT p_partkey, p_size FROM part WHERE p_size {_op} 25", f"SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size {_op} 25")
_PART = "SELECT p_partkey FROM part WHERE "
for _key, _cond in {
    "filter_text_eq": "p_brand = 'Brand#11'",
    "filter_text_range": "p_brand >= 'Brand#2' AND p_brand < 'Brand#4'",
    "filter_and_or_not": "(p_size < 5 OR p_size > 45) AND NOT (p_brand = 'Brand#11' OR p_size = 50)",
    "filter_between": "p_size BETWEEN 10 AND 20",
    "filter_not_between": "p_size NOT BETWEEN 10 AND 20",
    "filter_in_int": "p_size IN (1, 7, 49)",
    "filter_in_text": "p_brand IN ('Brand#11', 'Brand#22')",
    "filter_not_in": "p_size NOT IN (1, 2, 3)",
    "filter_in_null_list": "p_size IN (1, NULL, 3)",
    "filter_like_prefix": "p_type LIKE 'ECON%'",
    "filter_like_underscore": "p_brand LIKE 'Brand#_1'",
    "filter_not_like": "p_type NOT LIKE '%STEEL'",
    "filter_like_column": "p_name LIKE p_name",
}.items():
    _sql(_key, _PART + _cond, _PART + _cond)
_LINE = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
for _key, _cond, _want in (
    ("filter_in_double", "l_quantity IN (1, 2, 50)", "l_quantity IN (1, 2, 50)"),
    ("filter_not_in_double", "l_quantity NOT IN (1, 2, 50)", "l_quantity NOT IN (1, 2, 50)"),
    ("filter_in_double_mixed", "l_quantity IN (3, l_linenumber, 'x')", "l_quantity = 3 OR l_quantity = l_linenumber"),
    ("filter_in_int_column_of_doubles", "l_linenumber IN (l_quantity, 7)", "l_linenumber = 7 OR l_linenumber = l_quantity"),
):
    _sql(_key, _LINE + _cond, _LINE + _want)
_sql("filter_int_truthy", _PART + "p_size % 2", _PART + "p_size % 2 <> 0")
_sql("filter_mixed_types", _PART + "p_brand = 1 OR p_size = '5' OR p_size = 5", _PART + "p_size = 5")
_sql("arith_div_mod", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, (0 - o_orderkey) / 7 AS nq, -o_orderkey % 7 AS nr FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, (0 - o_orderkey) // 7 AS nq, (-o_orderkey) % 7 AS nr FROM orders")
_sql("arith_neg", "SELECT p_partkey, -p_size AS n, - -p_size AS nn, p_size - -1 AS m FROM part", "SELECT p_partkey, -CAST(p_size AS BIGINT) AS n, CAST(p_size AS BIGINT) AS nn, CAST(p_size AS BIGINT) + 1 AS m FROM part")

_NULLS = {
    "null_3vl_eq": ("k = 2", "k = 2"),
    "null_3vl_eq_null": ("k = NULL", "CAST(NULL AS BOOLEAN)"),
    "null_3vl_ne": ("k != 2", "k <> 2"),
    "null_3vl_and": ("k > 1 AND m > 3", "k > 1 AND m > 3"),
    "null_3vl_or": ("k > 1 OR m > 3", "k > 1 OR m > 3"),
    "null_3vl_not": ("NOT k = 2", "NOT k = 2"),
    "null_3vl_between": ("m BETWEEN k AND 5", "CASE WHEN k IS NULL THEN NULL ELSE m BETWEEN k AND 5 END"),
    "null_3vl_not_between": ("m NOT BETWEEN 2 AND k", "CASE WHEN k IS NULL THEN NULL ELSE NOT (m BETWEEN 2 AND k) END"),
    "null_3vl_in": ("k IN (1, 2)", "CASE WHEN k IS NULL THEN FALSE ELSE k IN (1, 2) END"),
    "null_3vl_in_null": ("k IN (1, NULL)", "CASE WHEN k = 1 THEN TRUE ELSE NULL END"),
    "null_3vl_not_in": ("k NOT IN (1, 2)", "CASE WHEN k IS NULL THEN TRUE ELSE k NOT IN (1, 2) END"),
    "null_3vl_like": ("p LIKE '1%'", "p LIKE '1%'"),
    "null_3vl_is_null": ("k IS NULL", "k IS NULL"),
}
for _key, (_cond, _want) in _NULLS.items():
    _sql(_key, f"SELECT o_orderkey, {_cond} AS v FROM orders_n", f"SELECT o_orderkey, CAST(({_want}) AS BIGINT) AS v FROM orders_n")
    _sql(f"{_key}_where", f"SELECT o_orderkey FROM orders_n WHERE {_cond}", f"SELECT o_orderkey FROM orders_n WHERE {_want}")

_sql("fn_upper", "SELECT p_partkey, UPPER(p_name) AS u FROM part", "SELECT p_partkey, upper(p_name) AS u FROM part")
_sql("fn_lower", "SELECT c_custkey, LOWER(c_mktsegment) AS l FROM customer", "SELECT c_custkey, lower(c_mktsegment) AS l FROM customer")
_sql("fn_length", "SELECT doc_id, LENGTH(text) AS n FROM documents", "SELECT doc_id, length(text) AS n FROM documents")

# aggregation

_sql("agg_count_star", "SELECT COUNT(*) FROM lineitem", 'SELECT count(*) AS "COUNT(*)" FROM lineitem')
_sql("agg_count_col", "SELECT COUNT(k), COUNT(p), COUNT(*) FROM orders_n", 'SELECT count(k) AS "COUNT(k)", count(p) AS "COUNT(p)", count(*) AS "COUNT(*)" FROM orders_n')
_sql("agg_sum", "SELECT SUM(l_orderkey) AS s FROM lineitem", "SELECT CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem")
_sql("agg_avg_int", "SELECT AVG(l_orderkey) AS a, AVG(0 - l_partkey) AS b FROM lineitem", "SELECT CAST(sum(l_orderkey) // count(l_orderkey) AS BIGINT) AS a, CAST(sum(-l_partkey) // count(l_partkey) AS BIGINT) AS b FROM lineitem")
_sql("agg_min_max_int", "SELECT MIN(l_partkey) AS a, MAX(l_partkey) AS b FROM lineitem", "SELECT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem")
_sql("agg_min_max_text", "SELECT MIN(p_brand) AS a, MAX(p_name) AS b FROM part", "SELECT min(p_brand) AS a, max(p_name) AS b FROM part")
_sql("agg_multi", "SELECT COUNT(*) AS n, SUM(k) AS s, AVG(k) AS a, MIN(k) AS lo, MAX(p) AS hi FROM orders_n", "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS s, CAST(sum(k) // count(k) AS BIGINT) AS a, min(k) AS lo, max(p) AS hi FROM orders_n")
_sql("agg_filtered", "SELECT COUNT(*) AS n, SUM(l_linenumber) AS s FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag = 'R'", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag = 'R'")
_sql("agg_empty", "SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS lo FROM part WHERE p_size < 0", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, CAST(NULL AS BIGINT) AS a, min(p_name) AS lo FROM part WHERE p_size < 0")
_sql("group_one", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_orderkey) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
_sql("group_two_keys", "SELECT l_linestatus, l_returnflag, AVG(l_partkey) AS a, MAX(l_suppkey) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_linestatus, l_returnflag, CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS a, max(l_suppkey) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("group_null_key", "SELECT k, COUNT(*) AS n, COUNT(p) AS np, SUM(m) AS s FROM orders_n GROUP BY k", "SELECT k, count(*) AS n, count(p) AS np, CAST(sum(m) AS BIGINT) AS s FROM orders_n GROUP BY k")
_sql("group_filtered", "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
_sql("group_key_not_projected", "SELECT COUNT(*) AS n, MIN(c_custkey) AS lo FROM customer GROUP BY c_nationkey", "SELECT count(*) AS n, min(c_custkey) AS lo FROM customer GROUP BY c_nationkey")
_sql("group_order_agg_desc_limit", "SELECT c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey ORDER BY COUNT(*) DESC, c_nationkey LIMIT 5", 'SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS "COUNT(*)" FROM customer GROUP BY c_nationkey ORDER BY 2 DESC, 1 LIMIT 5')

# order and limit

_sql("order_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 50", "SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS p_size FROM part ORDER BY p_brand DESC, p_size, p_partkey LIMIT 50")
_sql("order_expr", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 20", "SELECT p_partkey FROM part ORDER BY -p_size, p_partkey LIMIT 20")
_sql("order_desc_nulls", "SELECT o_orderkey, k FROM orders_n ORDER BY k DESC, o_orderkey LIMIT 30", "SELECT o_orderkey, k FROM orders_n ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 30")
_sql("order_asc_nulls", "SELECT o_orderkey, p FROM orders_n ORDER BY p, o_orderkey DESC LIMIT 30", "SELECT o_orderkey, p FROM orders_n ORDER BY p ASC NULLS LAST, o_orderkey DESC LIMIT 30")
_sql("order_nonprojected", "SELECT c_name FROM customer ORDER BY c_nationkey, c_custkey DESC LIMIT 15", "SELECT c_name FROM customer ORDER BY c_nationkey, c_custkey DESC LIMIT 15")
_sql("topk", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10")
_sql("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", "SELECT o_orderkey FROM orders LIMIT 0")
_sql("agg_limit_zero", "SELECT COUNT(*) AS n FROM orders LIMIT 0", "SELECT count(*) AS n FROM orders LIMIT 0")

# joins

_JOIN = "FROM customer JOIN orders ON c_custkey = o_custkey"
_sql("join_inner", f"SELECT c_name, o_orderkey {_JOIN}", f"SELECT c_name, o_orderkey {_JOIN}")
_sql("join_reversed_on", "SELECT c_name, o_orderkey FROM customer INNER JOIN orders ON o_custkey = c_custkey", f"SELECT c_name, o_orderkey {_JOIN}")
_sql("join_filter", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'", f"SELECT c_custkey, o_orderkey {_JOIN} WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'")
_sql("join_order_limit", f"SELECT c_name, o_orderkey {_JOIN} ORDER BY c_name DESC, o_orderkey LIMIT 25", f"SELECT c_name, o_orderkey {_JOIN} ORDER BY c_name DESC, o_orderkey LIMIT 25")
_sql("join_null_keys", "SELECT o_orderkey, r_name FROM orders_n JOIN region ON k = r_regionkey", "SELECT o_orderkey, r_name FROM orders_n JOIN region ON k = r_regionkey")
_sql("join_type_mismatch", "SELECT r_name, n_name FROM region JOIN nation ON r_name = n_regionkey", "SELECT r_name, n_name FROM region JOIN nation ON FALSE")
_sql("join_star", "SELECT * FROM region JOIN nation ON r_regionkey = n_regionkey", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM region JOIN nation ON r_regionkey = n_regionkey")

# beyond the reference: aliases, more joins, sets, DISTINCT, HAVING, OFFSET, CASE

_sql("ext_join_group", f"SELECT c_mktsegment, COUNT(*) AS n, MAX(o_orderkey) AS m {_JOIN} GROUP BY c_mktsegment", f"SELECT c_mktsegment, count(*) AS n, max(o_orderkey) AS m {_JOIN} GROUP BY c_mktsegment")
_sql("ext_three_way", "SELECT r.r_name, COUNT(*) AS n FROM customer c JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_sql("ext_self_join", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("ext_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("ext_full_join", "SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_size", "SELECT s_suppkey, p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_size")
_sql("ext_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", "SELECT DISTINCT c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
_sql("ext_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
_sql("ext_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
_sql("ext_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
_sql("ext_case", "SELECT o_orderkey, CASE WHEN k > 2 THEN 'high' WHEN k > 0 THEN 'low' ELSE 'none' END AS c FROM orders_n", "SELECT o_orderkey, CASE WHEN k > 2 THEN 'high' WHEN k > 0 THEN 'low' ELSE 'none' END AS c FROM orders_n")
_sql("ext_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("ext_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_sql("ext_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
_sql("ext_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_sql("ext_double", "SELECT l_returnflag, MAX(l_quantity * 2) AS q, COUNT(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag", "SELECT l_returnflag, max(l_quantity * 2) AS q, count(*) AS n FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag")

# the benchmark's shapes

for _key, _text, _want in (
    ("wf_full_scan", "SELECT l_orderkey FROM lineitem", "SELECT l_orderkey FROM lineitem"),
    ("wf_filtered_scan", "SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0", "SELECT l_orderkey FROM lineitem WHERE l_partkey % 10 = 0"),
    ("wf_projection", "SELECT l_orderkey, l_returnflag, l_partkey FROM lineitem", "SELECT l_orderkey, l_returnflag, l_partkey FROM lineitem"),
    ("wf_limit", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000"),
    ("wf_order_small", "SELECT l_partkey FROM lineitem ORDER BY l_partkey LIMIT 100", "SELECT l_partkey FROM lineitem ORDER BY l_partkey LIMIT 100"),
    ("wf_order_full", "SELECT l_partkey, l_orderkey FROM lineitem ORDER BY l_partkey", "SELECT l_partkey, l_orderkey FROM lineitem ORDER BY l_partkey"),
    ("wf_agg_count", "SELECT COUNT(*) AS n FROM lineitem", "SELECT count(*) AS n FROM lineitem"),
    ("wf_agg_sum", "SELECT SUM(l_partkey) AS s FROM lineitem", "SELECT CAST(sum(l_partkey) AS BIGINT) AS s FROM lineitem"),
    ("wf_agg_avg", "SELECT AVG(l_partkey) AS a FROM lineitem", "SELECT CAST(sum(l_partkey) // count(l_partkey) AS BIGINT) AS a FROM lineitem"),
    ("wf_group_by", "SELECT l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY l_linenumber", "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linenumber"),
    ("wf_join", "SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey", "SELECT l_orderkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
):
    _sql(_key, _text, _want)

# bounded delivery


def _streamed(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Take a query's result in batches, write them to files as they come, and read these: no more than a few batches are held."""
    planned = tables(spark, sf_dir).plan(text)
    schema = to_arrow_schema(planned.df.schema)
    files, held = files_of(spark, new_folder(spark)), []

    def write() -> None:
        sink = pa.BufferOutputStream()
        pq.write_table(pa.Table.from_arrays([pa.array([v for b in held for v in b.data[i]], f.type) for i, f in enumerate(schema)], schema=schema), sink)
        files.create(f"part-{uuid.uuid4().hex}.parquet", sink.getvalue().to_pybytes())
        held.clear()

    for b in batches(planned.df):
        held.append(b)
        if len(held) == 64:
            write()
    write()
    return spark.read.schema(planned.df.schema).parquet(files.url("").rstrip("/"))


for _key, _text, _want in (
    ("stream_scan", "SELECT c_custkey, c_name FROM customer", "SELECT c_custkey, c_name FROM customer"),
    ("stream_filter", "SELECT p_partkey FROM part WHERE p_size > 40 LIMIT 1000000", "SELECT p_partkey FROM part WHERE p_size > 40"),
    ("stream_group", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY o_custkey", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    ("stream_join", f"SELECT c_name, o_orderkey {_JOIN} WHERE o_orderstatus = 'P'", f"SELECT c_name, o_orderkey {_JOIN} WHERE o_orderstatus = 'P'"),
):
    QUERIES[_key] = lambda spark, sf_dir, text=_text: _streamed(spark, sf_dir, text)
    ORACLES[_key] = _want

# tables of its own: statements, transactions, indexes, replica

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation"


def _nation(spark: SparkSession, sf_dir: str, **options) -> Database:
    db = database(spark, **options)
    db.execute("CREATE TABLE t (k INTEGER NOT NULL, v TEXT)")
    db.load("t", spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name"))
    return db


@_query("SELECT * FROM (VALUES (1::BIGINT, 'Ada'), (2, 'it''s'), (3, NULL)) AS x(id, name)")
def ddl_create_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.execute("CREATE TABLE IF NOT EXISTS u (id INTEGER NOT NULL, name TEXT)")
    db.execute("INSERT INTO u VALUES (1, 'Ada'), (2, 'it''s')")
    db.execute("INSERT INTO u VALUES (3, NULL)")
    return db.query("SELECT * FROM u")


@_query("""SELECT * FROM (VALUES ('alpha'), ('beta')) AS x("table")""")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.execute("CREATE TABLE beta (x INTEGER)")
    db.execute("CREATE TABLE alpha (y TEXT)")
    r = db.execute("SHOW TABLES")
    return spark.createDataFrame(r.rows, "table string")


@_query(f"{_NATION} UNION ALL SELECT 100, 'new'")
def txn_own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir).session()
    s.execute("BEGIN")
    s.execute("INSERT INTO t VALUES (100, 'new')")
    return s.query("SELECT k, v FROM t")


@_query(_NATION)
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _nation(spark, sf_dir).session()
    s.execute("BEGIN TRANSACTION")
    s.execute("INSERT INTO t VALUES (100, 'new')")
    s.execute("ROLLBACK")
    return s.query("SELECT k, v FROM t")


@_query("SELECT count(*) AS n FROM nation")
def txn_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    reader = db.session()
    reader.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (100, 'new')")
    return reader.query("SELECT COUNT(*) AS n FROM t")


@_query(f"{_NATION} UNION ALL SELECT 100, 'new'")
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    with db.session() as s:
        s.execute("BEGIN WORK")
        s.execute("INSERT INTO t VALUES (100, 'new')")
        s.execute("COMMIT")
    return db.query("SELECT k, v FROM t")


@_query("SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_custkey = 7")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    return db.query("SELECT k, p FROM o WHERE c = 7")


@_query("SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_custkey = 7 AND o_orderkey > 500")
def index_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _orders(spark, sf_dir)
    return db.query("SELECT k, p FROM o WHERE c = 7 AND k > 500")


@_query("SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_custkey >= 100")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).index("by_customer").scan_from(100)


def _orders(spark: SparkSession, sf_dir: str) -> Database:
    db = database(spark)
    db.execute("CREATE TABLE o (k INTEGER NOT NULL, c INTEGER, p TEXT)")
    db.execute("CREATE INDEX by_customer ON o (c)")
    db.load("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority"))
    db.optimize("o")
    return db


@_query(_NATION)
def replica_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    return db.query("SELECT k, v FROM t", source="replica")


@_query(f"{_NATION} UNION ALL SELECT 100, 'new'")
def replica_multi_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    db.execute("INSERT INTO t VALUES (100, 'new')")
    db.flush_to_columnar()
    return db.query("SELECT k, v FROM t", source="replica")


@_query("SELECT n_name AS v FROM nation WHERE n_nationkey < 10")
def replica_filtered_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir, replica=True)
    db.flush_to_columnar()
    return db.replica.reader("t").read_filtered_projected("k < 10", ["v"])


@_query("SELECT count(*) + 1 AS n FROM nation")
def recovery_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    db.execute("INSERT INTO t VALUES (100, 'new')")
    s = db.session()
    s.execute("BEGIN")
    s.execute("INSERT INTO t VALUES (101, 'lost')")
    db.close()
    return Database.open(spark, db.log.files.url("")).query("SELECT COUNT(*) AS n FROM t")


@_query("SELECT CAST(n_nationkey AS BIGINT) + CASE WHEN n_nationkey % 2 = 1 THEN 1000 ELSE 0 END AS k, CASE WHEN n_nationkey % 2 = 1 THEN lower(n_name) ELSE n_name END AS v FROM nation")
def ext_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    db.execute("UPDATE t SET k = k + 1000, v = LOWER(v) WHERE k % 2 = 1")
    return db.query("SELECT k, v FROM t")


@_query(f"SELECT * FROM ({_NATION}) WHERE k > 10")
def ext_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    db.execute("DELETE FROM t WHERE k <= 10")
    return db.query("SELECT k, v FROM t")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS title, CAST(NULL AS BIGINT) AS extra FROM nation")
def admin_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _nation(spark, sf_dir)
    admin = Admin(db)
    admin.add_column("t", "extra", "bigint")
    admin.rename_column("t", "v", "title")
    admin.duplicate_table("t", "copy")
    admin.drop_table("t")
    return db.query("SELECT * FROM copy")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation ORDER BY n_name LIMIT 5 OFFSET 5")
def admin_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Admin(_nation(spark, sf_dir)).browse("t", page=1, size=5, order_by="v")
    return spark.createDataFrame(r.rows, "k long, v string")


FLAGSHIP = "SELECT l_returnflag, COUNT(*) AS n, SUM(l_orderkey) AS s FROM lineitem WHERE l_linenumber >= 2 GROUP BY l_returnflag ORDER BY l_returnflag"
