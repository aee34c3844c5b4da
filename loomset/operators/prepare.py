"""From raw records to a table of cleaned texts, and what there is to tell about it.

scored() cleans every text once; first_ones() and receipt() both read what it gives. run() writes that in between, so that
at any size the dear part is done once and lost executors cost their tasks alone.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions.scalars import parse_date
from loomset.operators import clean
from loomset.operators.kpi import count_where
from loomset.sources import files
from loomset.sources.tables import require_columns

#: Values of the receipt's list of products.
TOP_PRODUCTS = 20


def renamed(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The named columns under new names, as text; null is the empty text. All of them must be there."""
    require_columns(rows, names)
    return rows.select(*(F.coalesce(F.col(f"`{old}`").cast("string"), F.lit("")).alias(new) for old, new in names.items()))


def scored(rows: DataFrame, text: str, least: int = clean.MIN_CHARS) -> DataFrame:
    """Rows with some text: the text redacted in place, redaction_applied, char_count, word_count, sha256 and long_enough."""
    everyone = rows.withColumn("_any", F.lit("x"))
    cleaned = clean.cleaned(everyone, "_any", text).drop("_any", text).withColumnRenamed("redacted", text)
    return cleaned.withColumn("long_enough", F.col("char_count") >= least)


def first_ones(found: DataFrame, key: str, order: str, dates: Sequence[str], snapshot: str, url: str, formats: Sequence[str] = ()) -> DataFrame:
    """The first row, by an explicit order, of each id that isn't blank, among those that are long enough.

    dates become 'YYYY-MM-DD' (null if nothing can read them); month is that of the first one; source_snapshot and source_url are added.
    """
    rows = found.filter("long_enough").drop("long_enough").withColumn(key, F.trim(key)).filter(F.col(key) != "")
    rows = clean.keep_first(rows, key, order)
    rows = rows.withColumns({d: F.date_format(parse_date(F.col(d), *formats), "yyyy-MM-dd") for d in dates})
    return rows.withColumns({"month": F.substring(dates[0], 1, 7), "source_snapshot": F.lit(snapshot), "source_url": F.lit(url)})


def receipt(source: DataFrame, found: DataFrame, written: DataFrame, key: str, date: str, product: str) -> DataFrame:
    """One row: source_rows, non_empty_rows, short_rows, redacted_rows, duplicate_ids, written_rows, exact_duplicate_texts, received_min, received_max, top_products."""
    named = F.col("long_enough") & (F.trim(key) != "")
    counts = found.agg(F.count(F.lit(1)).alias("non_empty_rows"), count_where(~F.col("long_enough")).alias("short_rows"), count_where(F.col("redaction_applied")).alias("redacted_rows"), count_where(named).alias("_named"))
    texts = written.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("least"), F.max(date).alias("most"))
    texts = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("written_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_texts"), F.min("least").alias("received_min"), F.max("most").alias("received_max"))
    top = written.groupBy(F.col(product).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(TOP_PRODUCTS)
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
    top = top.agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["value"], (-p["n"]).cast("string"))), "|").alias("top_products"))
    one = source.agg(F.count(F.lit(1)).alias("source_rows")).join(F.broadcast(counts)).join(F.broadcast(texts)).join(F.broadcast(top))  # one row each
    names = ("source_rows", "non_empty_rows", "short_rows", "redacted_rows", "duplicate_ids", "written_rows", "exact_duplicate_texts", "received_min", "received_max", "top_products")
    return one.withColumn("duplicate_ids", F.col("_named") - F.col("written_rows")).select(*names)


def run(spark: SparkSession, rows: DataFrame, names: Mapping[str, str], folder: str, *, key: str, text: str, dates: Sequence[str], product: str, order: str, snapshot: str, url: str, formats: Sequence[str] = (), least: int = clean.MIN_CHARS) -> dict:
    """Writes folder/texts (Parquet) and folder/receipt.json (one line), and returns the receipt. No usable text is an error.

    key, text, dates, product and order are new names. folder must be one that the driver and all executors see.
    """
    source = renamed(rows, names)
    writer = lambda frame, name: frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    writer(scored(source, text, least), "scored")
    found = spark.read.parquet(f"{folder}/scored")
    writer(first_ones(found, key, order, dates, snapshot, url, formats), "texts")
    written = spark.read.parquet(f"{folder}/texts")
    told = receipt(source, found, written, key, dates[0], product).first().asDict()
    if not told["written_rows"]:
        raise ValueError("no usable texts were found")
    told |= {"source_snapshot": snapshot, "source_url": url, "minimum_chars": least, "content": clean.content_digest(written).first().asDict(), "files": files.digest(spark, f"{folder}/texts")}
    spark.createDataFrame([(json.dumps(told, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/receipt.json")
    return told
