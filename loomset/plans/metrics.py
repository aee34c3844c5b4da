"""Queries on governed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import catalog as definitions
from loomset.operators import kpi, sampling
from loomset.plans.catalog import query
from loomset.roles import dispatches, records
from loomset.session import table

RECORDS_SQL = """records AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS record_id, o_orderdate AS received, strftime(o_orderdate, '%Y-%m') AS month,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'monetary' WHEN '2-HIGH' THEN 'non_monetary' WHEN '3-MEDIUM' THEN 'explanation'
      WHEN '4-NOT SPECIFIED' THEN 'in_progress' WHEN '5-LOW' THEN 'untimely' END AS response,
    CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS timely,
    o_custkey AS company, o_orderstatus AS status, o_orderpriority AS priority
  FROM orders)"""

MONTHLY_SQL = RECORDS_SQL + """, counted AS (
  SELECT month, count(*) AS complaint_count, count(*) FILTER (timely = 'Yes') AS y, count(*) FILTER (timely = 'No') AS n,
    count(*) FILTER (response = 'monetary') AS mon, count(*) FILTER (response = 'non_monetary') AS non,
    count(*) FILTER (response = 'explanation') AS ex, count(*) FILTER (response = 'in_progress') AS pr, count(*) FILTER (response = 'untimely') AS un
  FROM records GROUP BY month), monthly AS (
  SELECT month, CAST(month || '-01' AS DATE) AS month_start, last_day(CAST(month || '-01' AS DATE)) AS month_end, complaint_count,
    y AS timely_yes_count, n AS timely_no_count, y + n AS timely_known_count, mon AS monetary_relief_count, non AS non_monetary_relief_count,
    mon + non AS relief_count, ex AS closed_explanation_count, pr AS in_progress_count, un AS untimely_response_count,
    y / nullif(y + n, 0) AS timely_rate, (mon + non) / nullif(complaint_count, 0) AS relief_rate, pr / nullif(complaint_count, 0) AS in_progress_rate
  FROM counted)"""


@query(f"WITH {MONTHLY_SQL} SELECT * FROM monthly")
def kpi_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.monthly_kpis(records(spark, sf_dir))


START, END = "1996-01", "1998-12"
DIMENSIONS = ("status", "priority", "response", "timely")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.monthly_kpis(records(spark, sf_dir))


@query(f"""WITH {MONTHLY_SQL} SELECT CAST(coalesce(sum(complaint_count), 0) AS BIGINT) AS complaint_count,
    coalesce(sum(timely_yes_count) / nullif(sum(timely_known_count), 0), 0) AS timely_rate, coalesce(sum(relief_count) / nullif(sum(complaint_count), 0), 0) AS relief_rate,
    coalesce(sum(in_progress_count) / nullif(sum(complaint_count), 0), 0) AS in_progress_rate FROM monthly WHERE month BETWEEN '{START}' AND '{END}'""")
def kpi_overview_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.overview(_monthly(spark, sf_dir), START, END)


@query(f"WITH {MONTHLY_SQL} SELECT month, complaint_count FROM monthly ORDER BY complaint_count DESC, month LIMIT 3")
def kpi_top_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.top_n(_monthly(spark, sf_dir).select("month", "complaint_count"), "complaint_count", 3, "month")


@query(f"""WITH {MONTHLY_SQL} SELECT month, 'timely_rate' AS metric, timely_rate AS value FROM monthly UNION ALL SELECT month, 'relief_rate', relief_rate FROM monthly
    UNION ALL SELECT month, 'in_progress_rate', in_progress_rate FROM monthly""")
def kpi_rate_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.melt_rates(_monthly(spark, sf_dir), ["timely_rate", "relief_rate", "in_progress_rate"])


@query(f"WITH {MONTHLY_SQL} SELECT count(*) FILTER (timely_known_count <> complaint_count) AS unreconciled_months, count(*) AS months FROM monthly")
def reconcile_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).agg(kpi.count_where(F.col("timely_known_count") != F.col("complaint_count")).alias("unreconciled_months"), F.count(F.lit(1)).alias("months"))


CELLS_SQL = RECORDS_SQL + ", long AS (" + " UNION ALL ".join(f"SELECT month, '{d}' AS dimension, {d} AS value FROM records WHERE {d} IS NOT NULL" for d in DIMENSIONS) + """), cells AS (
  SELECT month, dimension, value, count(*) AS complaint_count FROM long GROUP BY ALL), shared AS (
  SELECT *, complaint_count / sum(complaint_count) OVER (PARTITION BY month, dimension) AS share_within_month,
    row_number() OVER (PARTITION BY month, dimension ORDER BY complaint_count DESC, value) AS place, sum(complaint_count) OVER (PARTITION BY month, dimension) AS total FROM cells)"""


@query(f"WITH {CELLS_SQL} SELECT month, dimension, value, complaint_count, share_within_month, CAST(0 AS BIGINT) AS sum_other_doc_count, CAST(0 AS BIGINT) AS doc_count_error_upper_bound FROM shared")
def kpi_dimension_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_cube(records(spark, sf_dir), DIMENSIONS)


@query(f"""WITH {CELLS_SQL}, kept AS (SELECT * FROM shared WHERE place <= 2) SELECT month, dimension, value, complaint_count, share_within_month,
    CAST(total - sum(complaint_count) OVER (PARTITION BY month, dimension) AS BIGINT) AS sum_other_doc_count, CAST(0 AS BIGINT) AS doc_count_error_upper_bound FROM kept""")
def kpi_dimension_topn_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_cube(records(spark, sf_dir), DIMENSIONS, top_n=2)


@query(f"""SELECT p_type AS product, count(*) AS complaint_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '{START}' AND '{END}' GROUP BY p_type ORDER BY complaint_count DESC, product LIMIT 10""")
def kpi_top_products_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(kpi.month_key("o_orderdate").between(START, END)).select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # lines are counted by part before they meet its attributes
    parts = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("product")), F.col("l_partkey") == F.col("p_partkey"))
    return kpi.top_n(parts.groupBy("product").agg(F.sum("n").alias("complaint_count")), "complaint_count", 10, "product")


@query(definitions.METRICS_SQL)
def metric_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return definitions.metric_table(spark)


@query("""SELECT 'orders' AS table_name, count(*) AS row_count, min(strftime(o_orderdate, '%Y-%m')) AS first_month, max(strftime(o_orderdate, '%Y-%m')) AS last_month FROM orders
    UNION ALL SELECT 'lineitem', count(*), min(strftime(l_shipdate, '%Y-%m')), max(strftime(l_shipdate, '%Y-%m')) FROM lineitem
    UNION ALL SELECT 'events', count(*), min(strftime(ts, '%Y-%m')), max(strftime(ts, '%Y-%m')) FROM events
    UNION ALL SELECT 'documents', count(*), NULL, NULL FROM documents""")
def warehouse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(name: str, ts: str | None) -> DataFrame:
        month = kpi.month_key(ts) if ts else F.lit(None).cast("string")
        return table(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.min(month).alias("first_month"), F.max(month).alias("last_month"))

    return one("orders", "o_orderdate").unionByName(one("lineitem", "l_shipdate")).unionByName(one("events", "ts")).unionByName(one("documents", None))


LAG_SQL = "(SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m') AS received_month, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0 AS routing_lag_hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"SELECT * FROM {LAG_SQL}")
def sample_routing_lag_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatches(spark, sf_dir).select("l_orderkey", "l_linenumber", "received_month", "routing_lag_hours")


@query(f"""SELECT count(*) AS sample_rows, count(DISTINCT l_orderkey) AS unique_ids, count(*) FILTER (routing_lag_hours > 360) AS over_15_days, count(*) FILTER (routing_lag_hours > 720) AS over_30_days,
    max(routing_lag_hours) AS max_hours FROM {LAG_SQL}""")
def quality_lag_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.col("routing_lag_hours")
    return dispatches(spark, sf_dir).agg(F.count(F.lit(1)).alias("sample_rows"), F.count_distinct("l_orderkey").alias("unique_ids"), kpi.count_where(hours > 360).alias("over_15_days"), kpi.count_where(hours > 720).alias("over_30_days"), F.max(hours).alias("max_hours"))


@query("""SELECT strftime(m, '%Y-%m') AS month, CAST(m AS DATE) AS month_start, last_day(CAST(m AS DATE)) AS month_end
    FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)""")
def month_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("first"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("last"))
    return sampling.month_sequence(span, "first", "last")
