"""Readers and writers with fixed schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(frame.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def register(spark: SparkSession, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> list[str]:
    """Views of Parquet paths by name. All required ones must exist; optional ones are left out if they don't."""
    if missing := [p for p in required.values() if not _exists(spark, p)]:
        raise FileNotFoundError(f"not found: {', '.join(missing)}")
    there = dict(required) | {k: p for k, p in (optional or {}).items() if _exists(spark, p)}
    for name, path in there.items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    return sorted(there)


def columns_of(spark: SparkSession, names: Sequence[str]) -> list[dict]:
    """Name and columns of each registered view among names."""
    return [{"table": n, "columns": [{"name": c.name, "type": c.dataType} for c in spark.catalog.listColumns(n)]} for n in names if spark.catalog.tableExists(n)]


def text_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, line_ends_in_fields: bool = True) -> DataFrame:
    """A CSV with a header, all columns text, empty ones '' rather than null.

    Quoted fields may hold line ends; then a file is one task. Without them a large file is read by many.
    """
    frame = spark.read.csv(path, header=True, multiLine=line_ends_in_fields, escape='"', inferSchema=False)
    if columns:
        require_columns(frame, columns)
    return frame.na.fill("")


def json_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON file that is one document or a list of them (cases of an evaluation, a receipt, a manifest), with a declared schema. What isn't JSON is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


#: Aggregation responses: counts by dimension and value, one JSON document for each month.
_BUCKETS = T.StructType(
    [
        T.StructField("buckets", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_count", T.LongType())]))),
        T.StructField("sum_other_doc_count", T.LongType()),
        T.StructField("doc_count_error_upper_bound", T.LongType()),
    ]
)


def aggregation_buckets(responses: DataFrame, json_column: str, dimensions: Sequence[str]) -> DataFrame:
    """Other columns with dimension, value, doc_count, sum_other_doc_count and doc_count_error_upper_bound, one row for each bucket."""
    lists = bucket_lists(responses, json_column, dimensions)
    others = [c for c in lists.columns if c != "buckets"]
    rows = lists.select(*others, F.explode("buckets").alias("_v"))
    zero = F.lit(0).cast("long")
    return rows.select(*others[:-2], F.col("_v.key").alias("value"), F.coalesce("_v.doc_count", zero).alias("doc_count"), *others[-2:])


def bucket_lists(responses: DataFrame, json_column: str, dimensions: Sequence[str]) -> DataFrame:
    """Other columns with dimension, buckets (key, doc_count), sum_other_doc_count and doc_count_error_upper_bound, one row for each dimension.

    A dimension that a response lacks has no buckets and zeros.
    """
    parsed = T.StructType([T.StructField("aggregations", T.StructType([T.StructField(d, T.StructType([T.StructField(d, _BUCKETS)])) for d in dimensions]))])
    others = [c for c in responses.columns if c != json_column]
    rows = responses.withColumn("_r", F.from_json(json_column, parsed))
    each = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(f"_r.aggregations.{d}.{d}").alias("b")) for d in dimensions))
    rows = rows.select(*others, F.explode(each).alias("_d")).select(*others, "_d.dimension", "_d.b")
    none, zero = F.array().cast(_BUCKETS["buckets"].dataType), F.lit(0).cast("long")
    return rows.select(*others, "dimension", F.coalesce("b.buckets", none).alias("buckets"), F.coalesce("b.sum_other_doc_count", zero).alias("sum_other_doc_count"), F.coalesce("b.doc_count_error_upper_bound", zero).alias("doc_count_error_upper_bound"))


def records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(frame: DataFrame, path: str, first: int | None = None) -> None:
    (frame.limit(first) if first else frame).write.mode("overwrite").csv(path, header=True)


def write_json_lines(frame: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a row, keys in order."""
    frame.select(*sorted(frame.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def receipt_json(row: DataFrame, **more: object) -> str:
    """A one-row frame of counts, with what else is to be recorded, as JSON."""
    return json.dumps(row.first().asDict(recursive=True) | more, ensure_ascii=False, sort_keys=True, default=str)
