"""Queries on themes and their cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators import clean, topic_model, topics
from loomset.plans.catalog import query
from loomset.session import kept, scratch_folder, table

#: Topics of the registered topic query, and what a document without terms has in place of one.
TOPICS = 12
NO_TOPIC, NO_LABEL = -1, "no terms"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assigned texts: a day, a group (props.k modulo 5, null if there is none) and a theme (event_type)."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("month"), (k % 5).alias("product"), F.length("event_type").cast("long").alias("topic_id"), F.col("event_type").alias("topic_label"))


CELLS_SQL = """assigned AS (SELECT strftime(ts, '%Y-%m-%d') AS month, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS product, length(event_type) AS topic_id, event_type AS topic_label FROM events),
  cells AS (SELECT month, product, topic_id, topic_label, count(*) AS narrative_count FROM assigned GROUP BY ALL),
  cube AS (SELECT *, CAST(sum(narrative_count) OVER (PARTITION BY month, product) AS BIGINT) AS group_month_total FROM cells)"""


@query(f"WITH {CELLS_SQL} SELECT *, narrative_count / group_month_total AS share FROM cube")
def theme_monthly_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.cube(_assigned(spark, sf_dir), "month", "product")


@query(f"WITH {CELLS_SQL} SELECT topic_id, topic_label, CAST(sum(narrative_count) AS BIGINT) AS narrative_count FROM cube GROUP BY ALL ORDER BY narrative_count DESC, topic_id")
def theme_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.totals(topics.cube(_assigned(spark, sf_dir), "month", "product"))


def document_topics(documents: DataFrame, least: int = 5) -> DataFrame:
    """doc_id, topic_id, topic_label and topic_score of every document. least: documents that have a term.

    Vocabulary and factors are learned from all distinct cleaned texts, so that copies pull no topic; then every document gets its
    topic. One that has no term (also a null or empty text) has NO_TOPIC, NO_LABEL and the score 0.
    """
    texts = kept(documents.select("doc_id", clean.topic_text(F.col("text")).alias("plain")), "texts")
    distinct = kept(clean.keep_first(texts.filter("plain <> ''").withColumn("_sha", F.sha2("plain", 256)), "_sha", "doc_id"), "distinct")
    try:
        model = topic_model.learn(distinct, "doc_id", "plain", TOPICS, min_df=least)
    except topic_model.TooFewTerms:
        none = (F.lit(NO_TOPIC).cast("long").alias("topic_id"), F.lit(NO_LABEL).alias("topic_label"), F.lit(0.0).alias("topic_score"))
        return documents.select("doc_id", *none)
    folder = scratch_folder(documents.sparkSession, "topics")
    topic_model.save(model, folder)
    found = topic_model.score(topic_model.load(documents.sparkSession, folder), texts, "doc_id", "plain")
    return found.withColumn("topic_label", F.coalesce("topic_label", F.lit(NO_LABEL)))


@query()
def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's topic, from factors of the term weights of all distinct ones."""
    return document_topics(table(spark, sf_dir, "documents"))


def _topics_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's topic with a month (from its id) and a product (its source)."""
    documents = table(spark, sf_dir, "documents")
    month = F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 20).cast("int")), "yyyy-MM")
    facts = documents.select(F.col("doc_id").alias("_id"), month.alias("month"), F.col("source").alias("product"))
    found = document_topics(documents)
    return facts.join(found, F.col("_id") == F.col("doc_id")).drop("_id")


@query()
def topic_cube_from_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cube of the topics that were found: how many documents of each month and product have each topic, and their share."""
    return topics.cube(_topics_by_month(spark, sf_dir), "month", "product")


@query()
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each topic has."""
    return topics.totals(topics.cube(_topics_by_month(spark, sf_dir), "month", "product"))
