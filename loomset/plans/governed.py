"""Queries through the SQL gateway: text by a user, checked and limited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomset.operators import gateway
from loomset.plans.catalog import query

VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

JOIN = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY customers DESC, n_name"
WINDOW = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders ORDER BY o_custkey, nth"
CUBE = "SELECT l_returnflag, l_linestatus, count(*) AS line_count FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST"
SETS = "(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0"
NAMED = "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey) SELECT o_orderstatus, count(*) AS order_count FROM big JOIN orders ON l_orderkey = o_orderkey WHERE quantity > 150 GROUP BY o_orderstatus"
ROLLUP = "SELECT o_orderstatus, o_orderpriority, count(*) AS order_count, count(*) FILTER (WHERE o_totalprice > 1000) AS dear FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) HAVING count(*) > 10 ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST"
GROUPING = "SELECT c_mktsegment, c_nationkey, count(DISTINCT c_custkey) AS customers FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ()) ORDER BY c_mktsegment NULLS FIRST, c_nationkey NULLS FIRST"
FRAMES = "SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after_next, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near_rows, ntile(4) OVER w AS quarter, first_value(o_orderkey) OVER w AS first_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) ORDER BY o_custkey, o_orderkey"
OUTER = "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 9) AS few FULL OUTER JOIN (SELECT * FROM region WHERE r_regionkey <> 2) AS kept ON n_regionkey = r_regionkey ORDER BY n_name NULLS FIRST, r_name NULLS FIRST"
THETA = "SELECT a.n_name AS less, b.n_name AS more FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey ORDER BY less, more"
CROSS = "SELECT r_name, flag, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region CROSS JOIN (SELECT DISTINCT l_returnflag AS flag FROM lineitem) AS flags ORDER BY r_name, flag"
LATERAL = "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 1) AS newest ORDER BY c_custkey"
ANTI = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) ORDER BY c_custkey"
ILIKE = "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%e%' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) ORDER BY p_partkey"


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return gateway.run(spark, sql, {v: f"{sf_dir.rstrip('/')}/{v}.parquet" for v in VIEWS})


def _limited(sql: str) -> str:
    return f"SELECT * FROM ({sql}) LIMIT {gateway.MAX_ROWS}"


@query(_limited(JOIN))
def governed_sql_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, JOIN)


@query(_limited(WINDOW))
def governed_sql_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, WINDOW)


@query(_limited(CUBE))
def governed_sql_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CUBE)


@query(_limited(SETS))
def governed_sql_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SETS)


@query(_limited(NAMED))
def governed_sql_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, NAMED)


@query(_limited(ILIKE))
def governed_sql_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ILIKE)


@query(_limited(ROLLUP))
def governed_sql_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ROLLUP)


@query(_limited(GROUPING))
def governed_sql_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, GROUPING)


@query(_limited(FRAMES))
def governed_sql_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, FRAMES)


@query(_limited(OUTER))
def governed_sql_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, OUTER)


@query(_limited(THETA))
def governed_sql_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, THETA)


@query(_limited(CROSS))
def governed_sql_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CROSS)


@query(_limited(LATERAL))
def governed_sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, LATERAL)


@query(_limited(ANTI))
def governed_sql_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ANTI)
