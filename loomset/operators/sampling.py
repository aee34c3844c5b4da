"""Samples that are the same each time, because their order follows from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_key(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def balanced(frame: DataFrame, key: str, group: str, n: int, seed: int = 42, in_order_of_groups: bool = False) -> DataFrame:
    """n rows with as equal a share of each group (null is one) as there is; free places go to the rest; all rows if there are no more.

    Each group gives max(n // groups, 1) rows by stable key; what is left over is filled, and what is too much trimmed, by the same
    key over all groups. A row can only be taken if it is among the n first of its group, so a rank-limited window
    prunes each group before anything is sorted as a whole. in_order_of_groups: what is too much is trimmed from the last groups (null is
    the very last) instead.
    """
    groups = frame.select(group).distinct().count()
    base = max(n // max(groups, 1), 1)
    rows = frame.withColumn("_stable", stable_key(F.col(key), seed))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_stable", key))).filter(F.col("_rank") <= n)
    first = [F.when(F.col("_rank") <= base, F.col(group)).asc_nulls_last()] if in_order_of_groups else []
    return rows.orderBy((F.col("_rank") > base).cast("int"), *first, "_stable", key).limit(n).drop("_rank", "_stable")


def monthly_quota(frame: DataFrame, ts: str, key: str, limit: int, most_per_month: int = 100) -> DataFrame:
    """The newest rows of each month, ceil(limit / months) of each and most_per_month at most, until limit is reached in the order of months."""
    rows = frame.withColumn("_month", F.date_format(F.col(ts), "yyyy-MM"))
    months = rows.select("_month").distinct().count()
    quota = min(most_per_month, -(-limit // max(months, 1)))
    newest = Window.partitionBy("_month").orderBy(F.desc(ts), key)
    taken = rows.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= quota)
    return taken.orderBy("_month", "_rank").limit(limit).withColumnRenamed("_month", "month").withColumn("rank_in_month", F.col("_rank").cast("long")).drop("_rank")


def month_sequence(frame: DataFrame, start: str, end: str) -> DataFrame:
    """Every month from the first to the last of a one-row frame's two 'YYYY-MM' columns, both included. An end before the start is an error."""
    as_date = lambda c: F.to_date(F.concat(F.col(c), F.lit("-01")))
    wrong = F.raise_error(F.concat(F.lit("no month from "), F.col(start), F.lit(" to "), F.col(end)))
    frame = frame.select(F.when(F.col(start) > F.col(end), wrong.cast("string")).otherwise(F.col(start)).alias(start), end)
    return frame.select(F.explode(F.sequence(as_date(start), as_date(end), F.expr("interval 1 month"))).alias("_d")).select(F.date_format("_d", "yyyy-MM").alias("month"), F.col("_d").alias("month_start"), F.last_day("_d").alias("month_end"))
