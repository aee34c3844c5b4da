"""Which columns of the input tables play the roles the operators ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.kpi import month_key
from loomset.session import table

#: Order priorities stand for the five ways a record can be closed.
RESPONSES = {"1-URGENT": "monetary", "2-HIGH": "non_monetary", "3-MEDIUM": "explanation", "4-NOT SPECIFIED": "in_progress", "5-LOW": "untimely"}
TIMELY = {"F": "Yes", "O": "No"}


def _case(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for key, value in values.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as records: id, received, month, response, timely, company, status, priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("record_id"),
        F.col("o_orderdate").alias("received"),
        month_key("o_orderdate").alias("month"),
        _case("o_orderpriority", RESPONSES).alias("response"),
        _case("o_orderstatus", TIMELY).alias("timely"),
        F.col("o_custkey").alias("company"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order's date: received, sent, received_month and routing_lag_hours besides the keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("sent"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("received"))
    hours = (F.unix_micros(F.col("sent").cast("timestamp")) - F.unix_micros(F.col("received").cast("timestamp"))) / F.lit(1e6) / F.lit(3600.0)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("received_month", month_key("received")).withColumn("routing_lag_hours", hours)
