"""Queries on data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import quality
from loomset.plans.catalog import query
from loomset.roles import dispatches, records
from loomset.session import table

ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{kind}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, round(100 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_rate_pct, count(DISTINCT {c}) AS distinct_non_null FROM orders" for c, kind in ORDER_COLUMNS.items()))
def dq_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_profile(table(spark, sf_dir, "orders"), list(ORDER_COLUMNS))


@query("""WITH long AS (SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
    counts AS (SELECT column_name, coalesce(value, '<MISSING>') AS value, count(*) AS row_count FROM long GROUP BY ALL),
    ranked AS (SELECT *, sum(row_count) OVER (PARTITION BY column_name) AS total, row_number() OVER (PARTITION BY column_name ORDER BY row_count DESC, value) AS place FROM counts)
    SELECT column_name, value, row_count, round(100 * row_count / total, 2) AS share_pct FROM ranked WHERE place <= 20""")
def dq_category_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.category_top(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""SELECT (SELECT count(*) FROM lineitem) AS row_count, (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL) AS missing_ids, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS distinct_ids,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey) WHERE n > 1) AS rows_in_duplicate_ids,
    (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL)) AS exact_duplicate_rows""".replace("FROM lineitem GROUP BY ALL", "FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"))
def dq_key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_checks(table(spark, sf_dir, "lineitem"), "l_orderkey")


LAG_SQL = "(SELECT (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0 AS lag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""SELECT quantile_cont(lag, 0.5) AS median_days, quantile_cont(lag, 0.95) AS p95_days, max(lag) AS max_days, count(*) FILTER (lag < 0) AS negative,
    count(*) FILTER (lag > 15) AS over_15_days, count(*) FILTER (lag > 30) AS over_30_days, count(*) FILTER (lag IS NULL) AS unknown FROM {LAG_SQL}""")
def dq_lag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.lag_stats(dispatches(spark, sf_dir), "received", "sent")


FORMATS = {"c_name": "Customer#[0-9]+", "c_mktsegment": "[A-Z]+", "c_phone_zone": "[0-9]{2}"}


@query("""WITH c AS (SELECT c_name, c_mktsegment, CASE WHEN c_nationkey >= 10 THEN CAST(c_nationkey AS VARCHAR) WHEN c_nationkey > 4 THEN '0' || c_nationkey || 'X' END AS c_phone_zone FROM customer)
    """ + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (regexp_full_match({c}, '{p}')) AS valid, count(*) FILTER (NOT regexp_full_match({c}, '{p}')) AS invalid, count(*) FILTER ({c} IS NULL) AS missing FROM c" for c, p in FORMATS.items()))
def dq_format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_nationkey")
    zone = F.when(key >= 10, key.cast("string")).when(key > 4, F.concat(F.lit("0"), key.cast("string"), F.lit("X")))
    return quality.format_checks(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", zone.alias("c_phone_zone")), FORMATS)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS row_count FROM orders GROUP BY ALL ORDER BY month")
def dq_monthly_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.monthly_histogram(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O') ORDER BY value")
def dq_unexpected_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unexpected_values(records(spark, sf_dir), "status", ["F", "O"])
