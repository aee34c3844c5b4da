"""The same figures and the same cleaning over streams (an extension: what is rebuilt here has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomset.operators.clean import cleaned, length_gate


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Counts and sums a day and kind; days close when the watermark passes them."""
    windows = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind)
    return windows.agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("value_sum")).select(F.to_date("w.start").alias("day"), kind, "event_count", "value_sum")


def first_texts(texts: DataFrame, key: str, text: str, ts: str, late: str = "1 day") -> DataFrame:
    """Cleaned texts, each id once while it may still come again."""
    return length_gate(cleaned(texts, key, text)).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes all that is there, then ends; the checkpoint lets the next call go on where this one stopped."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
