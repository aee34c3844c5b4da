"""Search over chunks: terms, vectors, both together, with filters and citations.

A query's terms and vector are one row or a literal; what is searched is a table of postings (chunk, term,
weight) and a table of vectors. Filters come first, so that only candidates are scored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators import text as words

EXCERPT = 1200


@dataclass(frozen=True)
class Filters:
    """Equal if case is left aside (empty or None: no filter); dates as text, both ends included; null dates match no bound."""

    equal: tuple[tuple[str, str], ...] = ()
    date_column: str = "date"
    date_from: str | None = None
    date_to: str | None = None
    topic_id: int | None = None

    def condition(self, columns: Sequence[str]) -> Column:
        out = F.lit(True)
        for name, value in self.equal:
            if value:
                out &= F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))) == value.lower()
        if self.date_from:
            out &= F.coalesce(F.col(self.date_column) >= self.date_from, F.lit(False))
        if self.date_to:
            out &= F.coalesce(F.col(self.date_column) <= self.date_to, F.lit(False))
        if self.topic_id is not None:
            out &= F.coalesce(F.col("topic_id"), F.lit(-1)) == self.topic_id if "topic_id" in columns else F.lit(False)
        return out


def check_request(query: str, top_k: int, dense_weight: float = 0.65) -> str:
    query = " ".join(query.split())
    if not query:
        raise ValueError("nothing is asked for")
    if not 1 <= top_k <= 50:
        raise ValueError(f"top_k is 1 to 50, not {top_k}")
    if not 0 <= dense_weight <= 1:
        raise ValueError(f"dense_weight is a share from 0 to 1, not {dense_weight}")
    return query


def query_terms(frame: DataFrame, terms: DataFrame) -> DataFrame:
    """term and weight of a one-row frame's column query."""
    counts = words.term_counts(frame.select(F.lit(0).alias("_q"), "query"), "_q", "query")
    return words.weights(counts, terms, "_q").select("term", F.col("weight").alias("query_weight"))


def lexical_scores(postings: DataFrame, query: DataFrame, key: str) -> DataFrame:
    """key and lexical. query has a row for each word of one question at most, so it is small enough to broadcast."""
    return postings.join(F.broadcast(query), "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("query_weight")).alias("lexical"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def dense_scores(vectors: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """key and dense: the cosine, below 0 as 0."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector)
    cosine = dot(v, literal) / F.greatest(F.sqrt(dot(v, v)) * F.sqrt(dot(literal, literal)), F.lit(1e-12))
    return vectors.select(key, F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)).alias("dense"))


def hybrid(candidates: DataFrame, lexical: DataFrame, dense: DataFrame, key: str, dense_weight: float = 0.65) -> DataFrame:
    """Candidates with lexical, dense and score."""
    both = candidates.join(lexical, key, "left").join(dense, key, "left")
    both = both.withColumn("lexical", F.coalesce("lexical", F.lit(0.0))).withColumn("dense", F.coalesce("dense", F.lit(0.0)))
    return both.withColumn("score", dense_weight * F.col("dense") + (1 - dense_weight) * F.col("lexical"))


def top(scored: DataFrame, key: str, top_k: int, min_score: float = 0.0, score: str = "score") -> DataFrame:
    """The best top_k rows with their rank (ties by key), then without those below min_score."""
    best = scored.orderBy(F.desc(score), key).limit(top_k)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("_s"), F.col(key).alias("_k"), F.struct(*best.columns).alias("r")))).alias("all"))  # top_k rows
    return ranked.select(F.posexplode("all").alias("_i", "x")).select((F.col("_i") + 1).cast("long").alias("rank"), "x.r.*").filter(F.col(score) >= min_score)


def cite(key: Column, snapshot: Column) -> Column:
    return F.format_string("Record ID %s — %s", key.cast("string"), snapshot)


def excerpt(text: Column, n: int = EXCERPT) -> Column:
    return F.substring(text, 1, n)


def document(chunks: DataFrame, key: str, value: object) -> DataFrame:
    """A document's chunks in order, as one row; none if there is none. Ids are compared as text, but the value takes the column's type, so that scans can skip."""
    asked = F.lit(str(value)).try_cast(chunks.schema[key].dataType)
    rows = chunks.filter((F.col(key) == asked) & (asked.cast("string") == str(value)))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda x: x["chunk_text"]).alias("texts"))
