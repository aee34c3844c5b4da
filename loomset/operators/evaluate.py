"""Metrics of answers and searches against expected cases, as one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how a record is cited.
CITATION = r"(?i)(?:Record|Complaint)\s*ID\s*[:：#]?\s*[0-9]+"


def citations(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(CITATION)).cast("long")


def holds_all(found: Column, expected: Column) -> Column:
    """Whether every expected value was found; true if nothing is expected."""
    return F.size(F.array_except(expected, found)) == 0


def rates(cases: DataFrame, *conditions: str) -> DataFrame:
    """The share of cases in which each boolean column holds (null counts as false), and how many cases there are."""
    return cases.agg(F.count(F.lit(1)).alias("cases"), *(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(f"{c}_rate") for c in conditions))


def retrieval_cases(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: whether all results are of its product, each has a citation, and each expected term occurs in some result.

    results: case_id, product, citation, chunk_text; cases: case_id, product, expected_terms (a list made by hand). Terms are
    looked for in each result by itself, so that partial aggregates of booleans are all that is shuffled, however many results a case has.
    """
    case = ["case_id", "product", "expected_terms"]
    asked = cases.select(*case).distinct().select("case_id", F.col("product").alias("_product"), "expected_terms", F.explode_outer("expected_terms").alias("_term"))
    term = results.join(asked, "case_id").groupBy("case_id", "_product", "expected_terms", "_term").agg(
        F.count(F.lit(1)).alias("results"),
        F.bool_and(F.col("product").eqNullSafe(F.col("_product"))).alias("filtered"),
        F.bool_and(F.col("citation").isNotNull()).alias("cited"),
        F.bool_or(F.contains(F.lower(F.coalesce("chunk_text", F.lit(""))), F.lower("_term"))).alias("found"),
    )
    found = term.groupBy(F.col("case_id").alias("_case"), "_product", F.col("expected_terms").alias("_terms")).agg(
        F.max("results").alias("results"), F.bool_and("filtered").alias("filtered"), F.bool_and("cited").alias("cited"), F.bool_and(F.coalesce("found", F.lit(False))).alias("found")
    )
    same = (F.col("case_id") == F.col("_case")) & F.col("product").eqNullSafe(F.col("_product")) & F.col("expected_terms").eqNullSafe(F.col("_terms"))
    return cases.join(found, same, "left").select(
        "case_id",
        F.coalesce("results", F.lit(0)).alias("results"),
        F.coalesce("filtered", F.lit(False)).alias("filtered"),
        F.coalesce("cited", F.lit(False)).alias("cited"),
        F.coalesce((F.size("expected_terms") == 0) | F.col("found"), F.lit(False)).alias("covered"),
    )


def _judged(results: DataFrame, cases: DataFrame) -> DataFrame:
    """results: case_id (once), answer, route, events (an array of name, status, sql); a case without a result has no events and no answer."""
    return cases.join(results, "case_id", "left").withColumns({"answer": F.coalesce("answer", F.lit("")), "events": F.coalesce("events", F.array().cast(results.schema["events"].dataType))})


def _all_in(expected: str, held: Column) -> Column:
    """Whether a text holds all expected parts; nothing is expected by null or an empty list."""
    return F.coalesce(F.forall(F.col(expected), lambda x: F.contains(held, x)), F.lit(True))


def sql_cases(results: DataFrame, cases: DataFrame, sql_tool: str = "run_sql") -> DataFrame:
    """Per case of an assistant that queries: tool_use, sql_success (all calls went well, one at least if require_sql), tables, tools and numbers (all expected ones were used, called, told)."""
    rows = _judged(results, cases)
    sql = F.filter("events", lambda e: e["name"] == sql_tool)
    went_well = F.forall(sql, lambda e: e["status"] == "ok") & ((F.size(sql) > 0) | ~F.coalesce("require_sql", F.lit(True)))
    text = F.array_join(F.transform(sql, lambda e: e["sql"]), "\n")
    called = F.transform("events", lambda e: e["name"])
    expected_tools = F.coalesce("expected_tools", F.array().cast("array<string>"))
    return rows.select("case_id", (F.size("events") > 0).alias("tool_use"), went_well.alias("sql_success"), _all_in("expected_tables", text).alias("tables"), holds_all(called, expected_tools).alias("tools"), _all_in("expected_numbers", F.col("answer")).alias("numbers"))


def hybrid_cases(results: DataFrame, cases: DataFrame, sql_tool: str = "run_sql") -> DataFrame:
    """Per case of an assistant that queries and searches: route, tools (all expected ones went well at least once), tables, citations (enough of them) and how many tool_errors."""
    rows = _judged(results, cases)
    text = F.array_join(F.transform(F.filter("events", lambda e: e["name"] == sql_tool), lambda e: e["sql"]), " ")
    well = F.transform(F.filter("events", lambda e: e["status"] == "ok"), lambda e: e["name"])
    errors = F.size(F.filter("events", lambda e: e["status"] != "ok")).cast("long")
    return rows.select(
        "case_id",
        F.coalesce(F.col("route") == F.col("expected_route"), F.lit(False)).alias("route"),
        holds_all(well, F.coalesce("expected_tools", F.array().cast("array<string>"))).alias("tools"),
        _all_in("expected_tables", text).alias("tables"),
        (citations(F.col("answer")) >= F.col("minimum_citations")).alias("citations"),
        errors.alias("tool_errors"),
    )
