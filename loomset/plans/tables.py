"""Queries on sources, sinks and scalar functions: what is written and read back, parsed, filtered and formatted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import scalars
from loomset.operators import clean, kpi, quality, retrieval, sampling, text
from loomset.plans.catalog import query
from loomset.plans.metrics import CELLS_SQL, DIMENSIONS
from loomset.plans.texts import _WORD_SIGN, WEIGHTS_SQL, _twice, _weights
from loomset.roles import records
from loomset.session import scratch_folder, table
from loomset.sources import batches, tables, versions

FACTS_SQL = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")


@query(FACTS_SQL)
def written_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwritten once, then read back."""
    path = scratch_folder(spark, "parquet")
    tables.write_parquet(_facts(spark, sf_dir).limit(1), path)
    tables.write_parquet(_facts(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "csv")
    tables.write_csv(_facts(spark, sf_dir), path)
    return tables.text_csv(spark, path, ["s_suppkey", "s_name", "s_nationkey"])


@query(FACTS_SQL + " UNION ALL " + FACTS_SQL)
def written_json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is appended to, read with a declared schema."""
    path = scratch_folder(spark, "log")
    for _ in range(2):
        tables.write_json_lines(_facts(spark, sf_dir), path, append=True)
    return tables.records(spark, path, "s_suppkey long, s_name string, s_nationkey int")


@query("SELECT 'nation' AS view, (SELECT count(*) FROM nation) AS row_count UNION ALL SELECT 'region', (SELECT count(*) FROM region)")
def registered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of required paths and of an optional one that is not there."""
    path = lambda name: f"{sf_dir.rstrip('/')}/{name}.parquet"
    names = tables.register(spark, {"nation": path("nation"), "region": path("region")}, {"not_there": path("not_there")})
    out = None
    for name in names:
        one = spark.table(name).agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("row_count"))
        out = one if out is None else out.unionAll(one)
    return out


@query("SELECT table_name AS view, column_name, CAST(ordinal_position - 1 AS BIGINT) AS place FROM information_schema.columns WHERE table_name IN ('nation', 'region')")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered_views(spark, sf_dir)
    told = tables.columns_of(spark, ["nation", "region", "not_there"])
    return spark.createDataFrame([(t["table"], c["name"], i) for t in told for i, c in enumerate(t["columns"])], "view string, column_name string, place long")


RESPONSES_SQL = "months AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS key, count(*) AS doc_count FROM orders GROUP BY ALL)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation response for each month: statuses, and no priorities."""
    counts = table(spark, sf_dir, "orders").groupBy(kpi.month_key("o_orderdate").alias("month"), F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("doc_count"))
    bucket = F.struct("key", "doc_count")
    inner = F.struct(F.collect_list(bucket).alias("buckets"), F.lit(7).alias("sum_other_doc_count"))  # a few statuses
    return counts.groupBy("month").agg(F.to_json(F.struct(F.struct(F.struct(inner.alias("status"), F.lit(1).alias("doc_count")).alias("status")).alias("aggregations"))).alias("body"))


@query(f"WITH {RESPONSES_SQL} SELECT month, 'status' AS dimension, key AS value, doc_count, CAST(7 AS BIGINT) AS sum_other_doc_count, CAST(0 AS BIGINT) AS doc_count_error_upper_bound FROM months")
def aggregation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.aggregation_buckets(_responses(spark, sf_dir), "body", ["status", "priority"])


@query(f"""WITH {RESPONSES_SQL}, m AS (SELECT DISTINCT month FROM months) SELECT m.month, coalesce((SELECT doc_count FROM months x WHERE x.month = m.month AND x.key = 'F'), 0) AS f_count, CAST(0 AS BIGINT) AS none_count, CAST(0 AS BIGINT) AS priorities FROM m""")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of single values, 0 for those that are not there, and a dimension that the responses lack."""
    lists = tables.bucket_lists(_responses(spark, sf_dir), "body", ["status", "priority"])
    status, priority = F.col("dimension") == "status", F.col("dimension") == "priority"
    found = lambda key: F.max(F.when(status, scalars.bucket_count(F.col("buckets"), key)))
    return lists.groupBy("month").agg(found("F").alias("f_count"), found("nothing").alias("none_count"), F.sum(F.when(priority, F.size("buckets")).otherwise(0)).alias("priorities"))


@query(f"WITH {CELLS_SQL} SELECT month, value, complaint_count FROM shared WHERE dimension = '{DIMENSIONS[0]}'")
def kpi_one_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.dimension_cube(records(spark, sf_dir), DIMENSIONS).filter(F.col("dimension") == DIMENSIONS[0]).select("month", "value", "complaint_count")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, substr(event_type, 1, 3) AS excerpt FROM events WHERE lower(coalesce(event_type, '')) = (SELECT min(lower(event_type)) FROM events)
    AND strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-01' AND '2024-06-30' AND user_id % 5 = 2""")
def filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search filters: a value in any case, days from and to (both included), a topic."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", (F.col("user_id") % 5).alias("topic_id"))
    kind = rows.agg(F.min(F.lower("event_type"))).first()[0]
    filters = retrieval.Filters(equal=(("event_type", kind.upper()),), date_column="day", date_from="2024-01-01", date_to="2024-06-30", topic_id=2)
    return rows.filter(filters.condition(rows.columns)).select("event_id", "day", retrieval.excerpt(F.col("event_type"), 3).alias("excerpt"))


@query("SELECT event_id FROM events WHERE false")
def filtered_without_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic filter on rows that have no topics leaves none."""
    rows = table(spark, sf_dir, "events").select("event_id")
    return rows.filter(retrieval.Filters(topic_id=2).condition(rows.columns))


@query("SELECT 'missing' AS kind, 'n_comment' AS column_name UNION ALL SELECT 'unexpected', 'n_regionkey'")
def schema_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quality.column_differences(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_comment"])
    return spark.createDataFrame([(kind, c) for kind, columns in told.items() for c in columns], "kind string, column_name string")


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL")
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").na.drop(subset=["lang", "source", "text"]).select("doc_id")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place, round(CAST(list_max(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def vector_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", scalars.arg_max(F.col("embedding")).cast("long").alias("place"), F.round(F.array_max("embedding").cast("double"), 6).alias("value"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(e[1] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) AS first_part, round(e[2] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) AS second_part FROM v""")
def vector_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.once(table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 3 * x.cast("double")).alias("e")), "u", scalars.unit(F.col("e")))
    return rows.select("vec_id", *(F.round(F.col("u")[i], 6).alias(name) for i, name in enumerate(("first_part", "second_part"))))


@query(f"""WITH {WEIGHTS_SQL}, totals AS (SELECT source, term, round(sum(weight), 6) AS total FROM weights JOIN documents USING (doc_id) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY total DESC, term) AS place FROM totals) SELECT source, string_agg(term, ' / ' ORDER BY place) AS label FROM ranked WHERE place <= 6 GROUP BY source""")
def top_terms_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six heaviest terms of each source as its label."""
    weights = _weights(spark, sf_dir)[1].join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return text.top_labels(weights.groupBy("source", "term").agg(F.round(F.sum("weight"), 6).alias("total")), "source", "term", "total", 6)


#: Every third text gets masks and numbers, alone, in a row and inside words.
MASKED_SQL = "CASE WHEN doc_id % 3 = 0 THEN 'On XX/XX/2024 xxxx xx 12 34 x1 é7 ' || coalesce(text, '') || ' 9' ELSE text END"
TOPIC_TEXT_SQL = f"lower(coalesce({MASKED_SQL}, ''))"
for _alone in ("x{2,}", "[0-9]+"):
    TOPIC_TEXT_SQL = _twice(TOPIC_TEXT_SQL, f"(^|[^{_WORD_SIGN}]){_alone}($|[^{_WORD_SIGN}])", r"\1{}\2", " ")


@query(f"""SELECT doc_id, sha256(trim(regexp_replace({TOPIC_TEXT_SQL}, '\\s+', ' ', 'g'))) AS sha256 FROM documents""".replace("\\\\", "\\"))
def topic_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as topics read them: without masks and numbers that stand alone."""
    masked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("On XX/XX/2024 xxxx xx 12 34 x1 é7 "), F.coalesce("text", F.lit("")), F.lit(" 9"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean.topic_text(masked), 256).alias("sha256"))


ARCHIVED_SQL = "SELECT CAST(doc_id // 2 AS VARCHAR) AS record_id, doc_id, source, sha256(coalesce(text, '')) AS sha256 FROM documents"


def _archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).cast("string").alias("record_id"), "doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query(f"""WITH a AS ({ARCHIVED_SQL}) SELECT record_id, doc_id, source, sha256 FROM a QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY doc_id % 3, doc_id) = 1""")
def batches_with_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an archive that comes in three batches, the second of them twice; two rows share an id, and the first one loaded stays."""
    folder, rows = scratch_folder(spark, "batches"), _archived(spark, sf_dir)
    for k in (0, 1, 1, 2):
        batches.append(rows.filter(F.col("doc_id") % 3 == k), folder, f"part-{k}", "record_id", "doc_id", "sha256")
    return batches.read(spark, folder)


@query(f"""WITH a AS ({ARCHIVED_SQL}), parts AS (SELECT *, doc_id % 3 AS k FROM a), firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY record_id, k ORDER BY doc_id) = 1),
  new AS (SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.record_id = f.record_id AND p.k < f.k))
  SELECT 'part-' || k AS batch, (SELECT count(*) FROM parts p WHERE p.k = f.k) AS source_rows, count(*) - (SELECT count(*) FROM new n WHERE n.k = f.k) AS seen_before, (SELECT count(*) FROM new n WHERE n.k = f.k) AS written_rows,
    (SELECT count(DISTINCT n.sha256) FROM new n WHERE n.k = f.k AND EXISTS (SELECT 1 FROM new b WHERE b.sha256 = n.sha256 AND b.k < n.k)) AS texts_there_already FROM firsts f GROUP BY k""")
def batch_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read, left out and written, by batch."""
    folder, rows = scratch_folder(spark, "batches"), _archived(spark, sf_dir)
    told = [batches.append(rows.filter(F.col("doc_id") % 3 == k), folder, f"part-{k}", "record_id", "doc_id", "sha256") for k in range(3)]
    fields = ("batch", "source_rows", "seen_before", "written_rows", "texts_there_already")
    return spark.createDataFrame([tuple(m[f] for f in fields) for m in told], "batch string, source_rows long, seen_before long, written_rows long, texts_there_already long")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def versioned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two versions, of which the second is read; its files are held against their digest."""
    folder, rows = scratch_folder(spark, "orders"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    versions.write(rows.filter("o_orderstatus = 'O'"), folder)
    versions.write(rows, folder, check=lambda written: quality.require_unique(written, "o_orderkey"))
    versions.prune(spark, folder)
    return versions.read(spark, folder, verify=True)


@query("""SELECT event_id, '{"event_id":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","value":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '1.5' END || '}' AS payload FROM events""")
def events_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with ISO times; what is no number of JSON is null."""
    value = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.struct("event_id", at.alias("at"), scalars.finite(value).alias("value"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


@query("""WITH r AS (SELECT doc_id, source, sha256('42:' || doc_id) AS k, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS place FROM documents)
    SELECT doc_id, source FROM r WHERE place <= 1 ORDER BY source NULLS LAST, k LIMIT 3""")
def balanced_sample_in_order_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer places than groups: one row of each, in their order."""
    return sampling.balanced(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "source", 3, in_order_of_groups=True)
