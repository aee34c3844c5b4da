"""Profiles of a table: nulls, categories, keys, dates and formats.

Each profile is one pass with partial aggregates; only counts leave the tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.operators import quantiles
from loomset.operators.kpi import count_where
from loomset.session import kept

MISSING = "<MISSING>"


def null_profile(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column_name, dtype, null_count, null_rate_pct (2 places) and distinct_non_null of each column, most nulls first."""
    columns = list(columns or frame.columns)
    long = frame.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).unpivot([], columns, "column_name", "value")
    # values are counted first, so that a column with few values sends few rows on
    values = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    null = F.col("value").isNull()
    return (
        values.groupBy("column_name")
        .agg(F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_count"), F.sum("n").alias("_rows"), count_where(~null).alias("distinct_non_null"))
        .select("column_name", _type_of(frame, columns).alias("dtype"), "null_count", F.round(100 * F.col("null_count") / F.col("_rows"), 2).alias("null_rate_pct"), "distinct_non_null")
        .orderBy(F.desc("null_rate_pct"), "column_name")
    )


def _type_of(frame: DataFrame, columns: Sequence[str]) -> Column:
    """The type of the column that column_name names."""
    out = F.lit(None).cast("string")
    for c in columns:
        out = F.when(F.col("column_name") == c, frame.select(f"`{c}`").schema[0].dataType.simpleString()).otherwise(out)
    return out


def category_top(frame: DataFrame, columns: Sequence[str], n: int = 20) -> DataFrame:
    """The n most frequent values of each column (nulls as '<MISSING>'; ties by value), with their share in per cent."""
    long = frame.select(*(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns)).unpivot([], list(columns), "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("row_count"))
    group = Window.partitionBy("column_name")
    ranked = counts.withColumn("_all", F.sum("row_count").over(group)).withColumn("_rank", F.row_number().over(group.orderBy(F.desc("row_count"), "value")))
    return ranked.filter(F.col("_rank") <= n).select("column_name", "value", "row_count", F.round(100 * F.col("row_count") / F.col("_all"), 2).alias("share_pct"))


def key_checks(frame: DataFrame, key: str) -> DataFrame:
    """One row: rows, missing_ids, distinct_ids, rows_in_duplicate_ids, exact_duplicate_rows."""
    by_key = frame.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    keys = by_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("_n"))), F.lit(0)).alias("missing_ids"),
        count_where(F.col("_key").isNotNull()).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(F.col("_key").isNotNull() & (F.col("_n") > 1), F.col("_n"))), F.lit(0)).alias("rows_in_duplicate_ids"),
    )
    whole = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("exact_duplicate_rows"))
    return keys.join(F.broadcast(whole))  # one row beside one row


def require_unique(frame: DataFrame, key: str) -> DataFrame:
    """The frame, or an error if a key is there twice."""
    twice = frame.groupBy(key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]!r} is not unique")
    return frame


def lag_days(start: Column, end: Column) -> Column:
    """Days between two timestamps, with fractions."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)


def lag_stats(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Median, 95th percentile (interpolated, exact) and maximum of the lag in days, and how often it is < 0, > 15, > 30 or unknown.

    The lags are written once; the quantiles are selected from them without sorting the column.
    """
    lags = kept(frame.select(lag_days(F.col(start), F.col(end)).alias("lag")), "lags")
    median, p95 = quantiles.quantiles(lags, "lag", [0.5, 0.95])
    return lags.agg(
        F.lit(median).cast("double").alias("median_days"),
        F.lit(p95).cast("double").alias("p95_days"),
        F.max("lag").alias("max_days"),
        count_where(F.col("lag") < 0).alias("negative"),
        count_where(F.col("lag") > 15).alias("over_15_days"),
        count_where(F.col("lag") > 30).alias("over_30_days"),
        count_where(F.col("lag").isNull()).alias("unknown"),
    )


#: Formats of states and postal codes, null being valid.
STATE, ZIP, MASKED_ZIP = "[A-Z]{2}", r"[0-9]{3}([0-9]{2})?", r"[0-9]{3}XX|XXXXX"


def format_checks(frame: DataFrame, formats: Mapping[str, str]) -> DataFrame:
    """column_name, valid, invalid and missing for columns whose values must match a pattern as a whole."""
    long = frame.select(*(F.col(c).cast("string").alias(c) for c in formats)).unpivot([], list(formats), "column_name", "value")
    good = F.lit(False)
    for name, pattern in formats.items():
        good = F.when(F.col("column_name") == name, F.col("value").rlike(f"^(?:{pattern})$")).otherwise(good)
    value = F.col("value")
    return long.groupBy("column_name").agg(count_where(value.isNotNull() & good).alias("valid"), count_where(value.isNotNull() & ~good).alias("invalid"), count_where(value.isNull()).alias("missing"))


def unexpected_values(frame: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Values that are neither null nor expected, in order."""
    return frame.select(F.col(column).alias("value")).filter(F.col("value").isNotNull() & ~F.col("value").isin(*expected)).distinct().orderBy("value")


def column_differences(frame: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Columns that are missing and columns that were not expected."""
    return {"missing": sorted(set(expected) - set(frame.columns)), "unexpected": sorted(set(frame.columns) - set(expected))}


def monthly_histogram(frame: DataFrame, ts: str) -> DataFrame:
    return frame.groupBy(F.date_format(F.col(ts), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("row_count")).orderBy("month")
