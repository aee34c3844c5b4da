"""Cleaning of texts: white space, redaction, length gate, first of equal ones, receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.kpi import count_where
from loomset.session import unused

MIN_CHARS = 80

#: What is redacted, in this order, and what is put in its place. Digits, letters at borders and white space are those of Unicode.
REDACTIONS = (
    (r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?U)(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)", "[REDACTED_PHONE]"),
    (r"(?U)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", "[REDACTED_SSN]"),
    (r"(?U)(?<!\d)\d{9,}(?!\d)", "[REDACTED_LONG_NUMBER]"),
)
#: Every pattern above needs one of these, so a text without them is left alone.
_HINT = r"(?U)@|\d{4}"
#: What cleaned() adds.
ADDED = ("redacted", "redaction_applied", "char_count", "word_count", "sha256")


def normalise(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null becomes the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def redact(text: Column) -> Column:
    done = text
    for pattern, mark in REDACTIONS:
        done = F.regexp_replace(done, pattern, mark)
    return F.when(text.rlike(_HINT), done).otherwise(text)


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a dear column that is computed once, however often later steps name it: expressions aren't merged across a generator."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def word_count(text: Column) -> Column:
    """Words of a normalised text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("long")


def cleaned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Adds redacted (text), redaction_applied, char_count, word_count and sha256 to rows with an id and some text.

    A table that has columns of these names is refused, as neither its values nor the new ones may be lost.
    """
    clash = {c.lower() for c in texts.columns} & set(ADDED)
    if clash:
        raise ValueError(f"columns that cleaning adds are there already: {sorted(clash)}")
    plain = unused(texts, "_plain")
    rows = once(texts.filter(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != ""), plain, normalise(F.col(text))).filter(F.col(plain) != "")
    rows = once(rows, "redacted", redact(F.col(plain)))
    applied, sha256 = (F.col("redacted") != F.col(plain)).alias("redaction_applied"), F.sha2("redacted", 256).alias("sha256")
    return rows.select("*", applied, F.length("redacted").cast("long").alias("char_count"), word_count(F.col("redacted")).alias("word_count"), sha256).drop(plain)


def length_gate(rows: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Rows whose redacted text has at least so many characters."""
    return rows.filter(F.col("char_count") >= least)


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by an explicit order; rows without an order come last, and of equal ones any is the same or told apart by a hash.

    One partial aggregate: of a key that very many rows share, one row of each task is dealt out. Null is a key like any other.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    place = F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)))
    first = rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.min_by(whole, place).alias("_row"))
    return first.select(*(F.col("_row").getField(c).alias(c) for c in rows.columns))


def receipt(texts: DataFrame, key: str, text: str, least: int = MIN_CHARS) -> DataFrame:
    """One row of counts: source_rows, non_empty, short_excluded, written, redacted, repeated ids and repeated texts of what is written."""
    source = texts.agg(F.count(F.lit(1)).alias("source_rows"), count_where(normalise(F.col(text)) != "").alias("non_empty"))
    rows = cleaned(texts, key, text)
    counts = rows.agg(
        count_where(F.col("char_count") < least).alias("short_excluded"),
        count_where(F.col("char_count") >= least).alias("written"),
        count_where((F.col("char_count") >= least) & F.col("redaction_applied")).alias("redacted_rows"),
    )
    written = length_gate(rows)
    texts_ = written.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_texts"))
    ids = written.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    return source.join(F.broadcast(counts)).join(F.broadcast(texts_)).join(F.broadcast(ids))  # one row each


def content_digest(frame: DataFrame) -> DataFrame:
    """row_count and a digest of all rows that does not depend on their order or on part files."""
    return frame.select(F.xxhash64(*frame.columns).alias("h")).agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def topic_text(text: Column) -> Column:
    """Lower case without masks (xx…) and numbers, white space collapsed."""
    low = F.lower(F.coalesce(text, F.lit("")))
    alone = r"(?<![\p{L}\p{M}\p{N}_])%s(?![\p{L}\p{M}\p{N}_])"
    low = F.regexp_replace(low, alone % "x{2,}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, alone % "[0-9]+", " "), r"\s+", " "))

