"""Definitions of the governed metrics."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Metric:
    name: str
    formula: str
    grain: str
    caveat: str


METRICS = (
    Metric("complaint_count", "count of records", "month", "a volume, not a rate: it says nothing about how many could have written"),
    Metric("timely_rate", "sum(timely_yes_count) / sum(timely_known_count)", "any months", "records without a known answer are not in the denominator"),
    Metric("relief_rate", "sum(relief_count) / sum(complaint_count)", "any months", "relief of any kind, whatever its worth"),
    Metric("in_progress_rate", "sum(in_progress_count) / sum(complaint_count)", "any months", "recent months are not closed yet"),
    Metric("routing_lag_hours", "sent - received", "record", "of a sample, which stands for itself alone"),
    Metric("theme_share", "narrative_count / group_month_total", "month and group", "a theme is a likeness of words, not a cause; sum counts before comparing months"),
)


def metric_catalog() -> list[dict]:
    return [asdict(m) for m in METRICS]


def metric_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.name, m.formula, m.grain, m.caveat) for m in METRICS], "metric string, formula string, grain string, caveat string")


METRICS_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in (m.name, m.formula, m.grain, m.caveat)) + ")" for m in METRICS) + ") AS t(metric, formula, grain, caveat)"
