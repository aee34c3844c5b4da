"""Word windows, terms and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.functions.scalars import ACCENTED, strip_accents
from loomset.operators.clean import normalise, once

MAX_WORDS, OVERLAP = 320, 48
TERM = r"[\p{L}\p{N}_]{2,}"
#: Short English words that carry no topic.
STOP_WORDS = "a about after all am an and any are as at be because been before being but by can could did do does for from had has have he her here him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who why will with would you your".split()


def check_windows(max_words: int, overlap: int) -> None:
    if max_words < 50:
        raise ValueError(f"a window has 50 words or more, not {max_words}")
    if not 0 <= overlap < max_words:
        raise ValueError(f"windows of {max_words} words can't share {overlap}")


def words(text: Column) -> Column:
    """The words between white space; none for a null or blank text."""
    return F.filter(F.split(normalise(text), " "), lambda w: w != "")


def windows(words: Column, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Column:
    """Windows of an array of words (best a column, as each window reads it), each sharing overlap words with the one before; none without words."""
    check_windows(max_words, overlap)
    step = max_words - overlap
    count = F.when(F.size(words) == 0, 0).otherwise(F.greatest(F.ceil((F.size(words) - max_words) / step), F.lit(0)) + 1).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(max_words)), " "))


def chunks(texts: DataFrame, key: str, text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """All other columns with chunk_index, chunk_id ('key_index') and chunk_text."""
    others = [c for c in texts.columns if c != text]
    rows = once(texts, "_words", words(F.col(text)))
    rows = rows.select(*others, F.posexplode(windows(F.col("_words"), max_words, overlap)).alias("_i", "chunk_text"))
    return rows.select(*others, F.col("_i").cast("long").alias("chunk_index"), F.concat_ws("_", F.col(key).cast("string"), F.col("_i").cast("string")).alias("chunk_id"), "chunk_text")


def tokens(text: Column) -> Column:
    """Runs of two or more letters, digits and _ of any script, in lower case and without accents, without stop words.

    The class is spelled out as engines disagree on word boundaries.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(low.rlike(ACCENTED), strip_accents(low)).otherwise(low)
    return F.filter(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def with_bigrams(words: Column) -> Column:
    """The words and each two neighbours, joined by a space."""
    starts = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.concat(words, F.transform(starts, lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))))


def term_counts(texts: DataFrame, key: str, text: str, bigrams: bool = False, among: DataFrame | None = None) -> DataFrame:
    """key, term and tf. among: a small table of the terms that matter; others then go before anything is shuffled."""
    found = once(texts.select(key, text), "_words", tokens(F.col(text)))
    found = found.select(key, F.explode(with_bigrams(F.col("_words")) if bigrams else F.col("_words")).alias("term"))
    if among is not None:
        found = found.join(F.broadcast(among.select("term")), "term", "left_semi")
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_tf"))


def vocabulary(counts: DataFrame, documents: int, min_df: int = 2, max_df: float = 0.98, max_features: int = 30_000) -> DataFrame:
    """term, df and idf of the most frequent terms among those that are neither too rare nor too common; ties by term."""
    return chosen(document_frequency(counts), documents, min_df, max_df, max_features)


def chosen(sums: DataFrame, documents: int, min_df: int = 2, max_df: float = 0.98, max_features: int = 30_000) -> DataFrame:
    """The vocabulary from term, df and corpus_tf."""
    kept = sums.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * documents)).orderBy(F.desc("corpus_tf"), "term").limit(max_features)
    return kept.select("term", "df", (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(counts: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """key, term and weight: (1 + ln tf) * idf, each document's of length one."""
    raw = counts.join(terms, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("_w"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / length).alias("weight"))


def top_labels(weights: DataFrame, group: str, term: str, weight: str, n: int) -> DataFrame:
    """group and label: its n heaviest terms (ties by term), joined by ' / '."""
    order = Window.partitionBy(group).orderBy(F.desc(weight), term)
    kept = weights.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n)  # n rows of each group
    return kept.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", term))), lambda x: x[term]), " / ").alias("label"))
