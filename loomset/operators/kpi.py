"""Governed metrics: monthly counts, ratios of sums and month-by-dimension cubes.

Rates are never averaged over months. Every rate is SUM(numerator) / SUM(denominator) over
the rows asked for, so the monthly table carries counts and its rates are for plotting only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = "yyyy-MM"


def month_key(ts: str) -> Column:
    """'YYYY-MM'; as text it sorts in time order."""
    return F.date_format(F.col(ts), MONTH)


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def monthly_kpis(records: DataFrame) -> DataFrame:
    """One row a month. records: month, timely ('Yes', 'No' or null), response (text).

    One pass with a partial aggregate on each side of the exchange, so what is shuffled is one
    row per month and task whatever the number of records. A rate is null if its denominator is 0.
    """
    response = F.col("response")
    counts = records.groupBy("month").agg(
        F.count(F.lit(1)).alias("complaint_count"),
        count_where(F.col("timely") == "Yes").alias("timely_yes_count"),
        count_where(F.col("timely") == "No").alias("timely_no_count"),
        count_where(response == "monetary").alias("monetary_relief_count"),
        count_where(response == "non_monetary").alias("non_monetary_relief_count"),
        count_where(response == "explanation").alias("closed_explanation_count"),
        count_where(response == "in_progress").alias("in_progress_count"),
        count_where(response == "untimely").alias("untimely_response_count"),
    )
    known = F.col("timely_yes_count") + F.col("timely_no_count")
    relief = F.col("monetary_relief_count") + F.col("non_monetary_relief_count")
    start = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    return counts.select(
        "month",
        start.alias("month_start"),
        F.last_day(start).alias("month_end"),
        "complaint_count",
        "timely_yes_count",
        "timely_no_count",
        known.alias("timely_known_count"),
        "monetary_relief_count",
        "non_monetary_relief_count",
        relief.alias("relief_count"),
        "closed_explanation_count",
        "in_progress_count",
        "untimely_response_count",
        F.try_divide("timely_yes_count", known).alias("timely_rate"),
        F.try_divide(relief, F.col("complaint_count")).alias("relief_rate"),
        F.try_divide("in_progress_count", "complaint_count").alias("in_progress_rate"),
    )


def ratio_of_sums(numerator: str, denominator: str) -> Column:
    """SUM(n) / SUM(d), 0 where that has no value."""
    return F.coalesce(F.try_divide(F.sum(numerator), F.sum(denominator)), F.lit(0.0))


def overview(monthly: DataFrame, start: str, end: str) -> DataFrame:
    """One row for the months start..end, both included."""
    return monthly.filter(F.col("month").between(start, end)).agg(
        F.coalesce(F.sum("complaint_count"), F.lit(0)).alias("complaint_count"),
        ratio_of_sums("timely_yes_count", "timely_known_count").alias("timely_rate"),
        ratio_of_sums("relief_count", "complaint_count").alias("relief_rate"),
        ratio_of_sums("in_progress_count", "complaint_count").alias("in_progress_rate"),
    )


def dimension_cube(records: DataFrame, dimensions: Sequence[str], top_n: int | None = None) -> DataFrame:
    """Long month x dimension x value counts with the share within the month.

    Counts are exact, so their error bound is 0. With top_n, each (month, dimension) keeps its
    top_n values (ties by value) and sum_other_doc_count holds the rest.
    """
    long = records.unpivot(["month"], list(dimensions), "dimension", "value").filter(F.col("value").isNotNull())
    cells = long.groupBy("month", "dimension", "value").agg(F.count(F.lit(1)).alias("complaint_count"))
    group = Window.partitionBy("month", "dimension")
    total = F.sum("complaint_count").over(group)
    cells = cells.withColumn("share_within_month", F.col("complaint_count") / total)
    if top_n is None:
        return cells.select("*", F.lit(0).cast("long").alias("sum_other_doc_count"), F.lit(0).cast("long").alias("doc_count_error_upper_bound"))
    order = group.orderBy(F.desc("complaint_count"), F.asc("value"))
    ranked = cells.withColumn("_rank", F.row_number().over(order)).withColumn("_total", total)
    kept = ranked.filter(F.col("_rank") <= top_n)
    other = F.col("_total") - F.sum("complaint_count").over(group)
    return kept.select("month", "dimension", "value", "complaint_count", "share_within_month", other.alias("sum_other_doc_count"), F.lit(0).cast("long").alias("doc_count_error_upper_bound"))


def melt_rates(monthly: DataFrame, rates: Sequence[str]) -> DataFrame:
    """Rates as (month, metric, value) rows for plotting."""
    return monthly.select("month", *rates).unpivot(["month"], list(rates), "metric", "value")


def top_n(frame: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """Largest n rows; the tie column makes the result stable."""
    return frame.orderBy(F.desc(by), F.asc(tie)).limit(n)
