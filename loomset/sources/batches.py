"""A table that grows by batches: ids that an earlier batch had add nothing, and neither does a batch that is loaded again.

Each batch has a folder of rows, a narrow one of ids and text hashes, and a manifest, which is written last by one rename. Only batches with a manifest exist for readers
and for later batches, so one that dies leaves no trace, and its next try begins from nothing. New ids are those that an anti-join with the narrow tables
leaves: texts of earlier batches are never read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import clean
from loomset.sources import files

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]*")


def loaded(spark: SparkSession, folder: str) -> list[dict]:
    """The manifests of all batches, in the order in which they were loaded."""
    found = [json.loads(files.read_small(spark, f"{folder}/manifests/{n}")) for n in files.names_in(spark, f"{folder}/manifests") if n.endswith(".json")]
    return sorted(found, key=lambda m: m["number"])


def _read(spark: SparkSession, folder: str, part: str, manifests: list[dict]) -> DataFrame | None:
    frames = [f"{folder}/{part}/{m['batch']}" for m in manifests if m["written_rows"]]
    return spark.read.parquet(*frames) if frames else None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of all batches."""
    found = _read(spark, folder, "rows", loaded(spark, folder))
    if found is None:
        raise FileNotFoundError(f"{folder} has no rows")
    return found


def append(frame: DataFrame, folder: str, batch: str, key: str, order: str, text_hash: str | None = None) -> dict:
    """Loads the rows of a batch whose ids are new, the first of each by an explicit order, and gives the batch's manifest.

    key: id column; null and blank ids are left out. text_hash: column to count texts by that are there already. A batch that is loaded already is left as it is.
    One writer at a time.
    """
    if not _NAME.fullmatch(batch):
        raise ValueError(f"{batch!r} is no name of a batch")
    spark = frame.sparkSession
    before = loaded(spark, folder)
    for manifest in before:
        if manifest["batch"] == batch:
            return manifest
    rows_path, seen_path = f"{folder}/rows/{batch}", f"{folder}/seen/{batch}"
    usable = frame.filter(F.trim(F.col(key).cast("string")) != "")
    first = clean.keep_first(usable, key, order)
    seen = _read(spark, folder, "seen", before)
    new = first if seen is None else first.join(seen.select(F.col("id").alias(key)), key, "left_anti").select(*frame.columns)
    new.write.mode("overwrite").option("compression", "zstd").parquet(rows_path)
    written = spark.read.schema(frame.schema).parquet(rows_path)
    ids = written.select(F.col(key).alias("id"), (F.col(text_hash) if text_hash else F.lit(None)).cast("string").alias("hash"))
    ids.write.mode("overwrite").option("compression", "zstd").parquet(seen_path)
    mine = spark.read.schema(ids.schema).parquet(seen_path)
    counts = usable.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("ids")).first()
    written_rows, hashes = mine.agg(F.count(F.lit(1)), F.count_distinct("hash")).first()
    told = {"batch": batch, "number": len(before), "source_rows": frame.count(), "rows_with_id": counts["rows"], "repeated_in_batch": counts["rows"] - counts["ids"], "seen_before": counts["ids"] - written_rows, "written_rows": written_rows}
    if text_hash:
        known = mine.select("hash").distinct()
        told["texts_there_already"] = 0 if seen is None else known.join(seen.select("hash").distinct(), "hash", "left_semi").count()
        told["repeated_texts_in_batch"] = mine.filter("hash IS NOT NULL").count() - hashes
    files.replace_small(spark, f"{folder}/manifests/{batch}.json", json.dumps(told))
    return told
