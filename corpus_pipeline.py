"""Cleaning and packing a corpus: STAGES in order, each a function of (spark, docs, sf_dir), written and reread between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import decontamination, langid, minhash, packing, pii
from loomset.llm.common import bound_batches, discard, discard_others, keep, kept_so_far, table, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language; lang becomes the recognised one. Null, empty and letterless texts go.

    Learned from the texts and lang of the documents that are not held out, as the language query learns. All other columns
    stay as they are, whatever their names.
    """
    bound_batches(spark)
    model = langid.learn(langid.training(docs))
    found = unused(docs, "lang_pred")
    kept = langid.predict(docs, model).filter(F.col(found) != langid.UNKNOWN)
    return kept.select(*(F.col(found).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    What is compared are texts, so rows that repeat an id with other texts stay unless these have copies of their own. Of rows that
    repeat id and text the one whose columns have the least hash stays. Rows without an id stay.
    """
    columns, ident, mark = [F.col(f"`{c}`") for c in docs.columns], unused(docs, "_id"), unused(docs, "_mark")
    found = minhash.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(ident), F.col("text_hash").alias(mark))
    marked = keep(found.agg(F.bool_and("first").alias("_stays"), F.count(F.lit(1)).alias("_rows")).filter("NOT _stays OR _rows > 1"), "marked")
    same = (F.col("doc_id") == F.col(ident)) & (minhash.text_hash() == F.col(mark))
    single = docs.join(marked, same, "left_anti")
    repeated = docs.join(marked.filter("_stays").select(ident, mark), same)
    first = repeated.groupBy(ident, mark).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return single.unionByName(first.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    replaced = pii.replace(docs)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack),
]

#: Learned models, shared signatures and token ids are beyond SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Between stages only the documents are kept; what a stage kept for itself goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = kept_so_far(spark)
        after = keep(stage(spark, docs, sf_dir), name)
        discard_others(spark, before, after)
        if docs is not after and hasattr(docs, "kept_at"):
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
