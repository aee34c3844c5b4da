"""The queries of this package, op1 to op13 and the pipeline, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import conversations, decontamination, fillmiddle, htmltext, langid, minhash, oracles, packing, pii, quality, substring, tokenstore, urlrules, vectors
from loomset.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_recurring(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.held_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.qualities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "first")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), count=True).select("doc_id", "text", "n_entities")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenstore.new_folder(spark)
    tokenstore.write(table(spark, sf_dir, "documents"), folder)
    return tokenstore.read_facts(spark, folder)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fillmiddle.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_lattice_near_dedup, op3_decontamination, op4_language_id, op5_quality_classifier, op6_minhash_near_dedup, op7_pii_surrogates, op8_html_extraction, op9_best_fit_packing, op10_token_store, op11_conversation_repair, op12_url_filter, op13_fill_in_middle)
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": oracles.OP1, "op2_lattice_near_dedup": oracles.OP2, "op6_minhash_near_dedup": oracles.OP6, "op11_conversation_repair": oracles.OP11, "op13_fill_in_middle": oracles.OP13}
