import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomset.operators import catalog, clean, evaluate, gateway, kpi, prepare, quality, retrieval, router, sampling, text, topics
from loomset.plans import themes
from loomset.sources import zipped, tables
from loomset.sources.paged import PagedRecords


def test_windows_share_their_overlap(spark):
    words = [f"w{i}" for i in range(120)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None), (4, " one \n two ")], "id int, body string")
    rows = text.chunks(frame, "id", "body", 50, 10).orderBy("id", "chunk_index").collect()
    first = [r["chunk_text"].split() for r in rows if r["id"] == 1]
    assert len(first) == 3 and first[0][-10:] == first[1][:10] and first[2][-1] == "w119"
    assert [(r["chunk_id"], r["chunk_text"]) for r in rows if r["id"] != 1] == [("4_0", "one two")]
    for bad in ((40, 5), (50, 50), (50, -1)):
        with pytest.raises(ValueError):
            text.check_windows(*bad)


def test_redaction_gate_and_first_of_equal_ones(spark):
    frame = spark.createDataFrame([("1", "mail a.b@c.org or 212-555-0199, 123-45-6789 and 123456789012  now"), ("2", None), ("3", "  "), ("", "some text"), ("4", "same words"), ("5", "same  words")], "id string, body string")
    rows = {r["id"]: r for r in clean.cleaned(frame, "id", "body").collect()}
    assert rows["1"]["redacted"] == "mail [REDACTED_EMAIL] or [REDACTED_PHONE], [REDACTED_SSN] and [REDACTED_LONG_NUMBER] now" and rows["1"]["redaction_applied"]
    assert set(rows) == {"1", "4", "5"} and rows["4"]["word_count"] == 2
    assert {r["id"] for r in clean.keep_first(clean.cleaned(frame, "id", "body"), "sha256", "id").collect()} == {"1", "4"}
    assert {r["id"] for r in clean.length_gate(clean.cleaned(frame, "id", "body"), 20).collect()} == {"1"}
    with pytest.raises(ValueError):
        clean.cleaned(frame.withColumn("SHA256", F.lit("own")), "id", "body")


def test_redaction_of_separated_and_joined_numbers(spark):
    """Separators of phones are optional; numbers inside longer ones, and addresses that begin inside a word, are as told here."""
    import re

    fixed = [(r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I, "[REDACTED_EMAIL]"), (r"(?<!\d)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}(?!\d)", 0, "[REDACTED_PHONE]"), (r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0, "[REDACTED_SSN]"), (r"(?<!\d)\d{9,}(?!\d)", 0, "[REDACTED_LONG_NUMBER]")]
    texts = ["(212)5550199", "212 5550199", "2125550199", "+1 (212) 555-0199", "12125550199 2125550199 x", "123456789", "12345678", "é.b@x.com ü+q@y.org, A@B.CO_ a@b.c1 né.55@m.io", "123-45-6789 123-45-67890", "٢١٢٥٥٥٠١٩٩", "4485168114407329"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean.redact(F.col("t")).alias("r")).collect()
    for r in rows:
        expected = r["t"]
        for pattern, flags, mark in fixed:
            expected = re.sub(pattern, mark, expected, flags=flags)
        assert r["r"] == expected
    assert rows[0]["r"] == rows[1]["r"] == rows[2]["r"] == "[REDACTED_PHONE]"


def test_first_of_repeated_rows(spark):
    """Repeated rows are one; a key without any order keeps a row; null is a key."""
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), ("b", None, "z"), (None, 5, "n"), (None, 3, "m")]
    found = clean.keep_first(spark.createDataFrame(rows, "k string, o int, v string"), "k", "o")
    assert found.columns == ["k", "o", "v"] and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", 1, "y"), ("b", None, "z"), (None, 3, "m")]))


def test_digest_does_not_depend_on_order(spark):
    frame = spark.range(100).withColumn("x", F.col("id") % 7)
    assert clean.content_digest(frame).first() == clean.content_digest(frame.orderBy(F.desc("id")).repartition(7)).first()
    assert clean.content_digest(frame).first() != clean.content_digest(frame.filter("id < 99")).first()


def test_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "month string, timely string, response string")
    assert kpi.monthly_kpis(empty).count() == 0
    assert kpi.overview(kpi.monthly_kpis(empty), "2020-01", "2020-12").first().asDict() == {"complaint_count": 0, "timely_rate": 0.0, "relief_rate": 0.0, "in_progress_rate": 0.0}


def test_profiles_with_nulls(spark):
    frame = spark.createDataFrame([(1, "A"), (1, None), (2, "A"), (None, "B"), (1, "A")], "k int, v string")
    nulls = {r["column_name"]: r.asDict() for r in quality.null_profile(frame).collect()}
    assert nulls["v"] == {"column_name": "v", "dtype": "string", "null_count": 1, "null_rate_pct": 20.0, "distinct_non_null": 2}
    assert quality.key_checks(frame, "k").first().asDict() == {"row_count": 5, "missing_ids": 1, "distinct_ids": 2, "rows_in_duplicate_ids": 3, "exact_duplicate_rows": 1}
    assert [(r["value"], r["row_count"]) for r in quality.category_top(frame, ["v"], 2).orderBy(F.desc("row_count")).collect()] == [("A", 3), ("<MISSING>", 1)]
    with pytest.raises(ValueError):
        quality.require_unique(frame, "k")
    assert quality.column_differences(frame, ["k", "z"]) == {"missing": ["z"], "unexpected": ["v"]}


def test_balanced_sample_sizes(spark):
    frame = spark.createDataFrame([(i, None if i % 50 == 0 else "a" if i % 10 else "b") for i in range(500)], "id int, g string")
    sample = sampling.balanced(frame, "id", "g", 60).collect()
    assert len(sample) == 60 and sum(r["g"] is None for r in sample) == 10
    assert sampling.balanced(frame, "id", "g", 2).count() == 2 and sampling.balanced(frame, "id", "g", 900).count() == 500


GOOD = "WITH m AS (SELECT month FROM kpis) SELECT month, count(*) AS n FROM m GROUP BY month"
BAD = [
    "", "SELECT FROM WHERE (", "SELECT 1; SELECT 2", "DROP TABLE kpis", "INSERT INTO kpis VALUES (1)", "SELECT * FROM secret", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other.kpis",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "WITH kpis AS (SELECT 1) SELECT * FROM kpis", "SELECT * FROM kpis WHERE month IN (SELECT x FROM secret)", "SELECT (SELECT max(x) FROM secret) FROM kpis",
    "WITH m AS (SELECT * FROM secret) SELECT * FROM m", "CREATE TABLE t AS SELECT 1", "SET spark.x = 1", "SHOW TABLES", "SELECT * FROM kpis LATERAL VIEW explode(array(1)) t AS x JOIN secret",
]


def test_gateway(spark, tmp_path):
    path = str(tmp_path / "kpis")
    spark.range(500).select(F.format_string("%03d", "id").alias("month")).write.parquet(path)
    assert gateway.check(spark, GOOD, ["kpis"]).tables == ("kpis",)
    for sql in BAD:
        with pytest.raises(gateway.NotAllowed):
            gateway.check(spark, sql, ["kpis"])
    assert gateway.run(spark, "SELECT * FROM kpis", {"kpis": path}).count() == 200
    assert gateway.run(spark, "SELECT month FROM kpis UNION SELECT 'x';", {"kpis": path}, requested=3).count() == 3
    assert gateway.check(spark, "SELECT 1", [], requested=0).limit == 1


def test_router_and_citations(spark):
    asked = ["How many in May?", "the account is separate", "Why do they complain about it?", "Compare rates and quote examples", "为什么"]
    frame = spark.createDataFrame([(a,) for a in asked], "q string")
    assert [r[0] for r in frame.select(router.route(F.col("q"))).collect()] == ["sql", "sql", "rag", "hybrid", "rag"]
    assert spark.createDataFrame([("see Record ID: 12 and complaint id #9, ID 3",)], "a string").select(evaluate.citations(F.col("a"))).first()[0] == 2


def test_filters_and_ranks(spark):
    frame = spark.createDataFrame([("a", "Loan", "2020-01-01", 1.0), ("b", "loan", None, 0.5), ("c", None, "2021-01-01", 0.01)], "id string, product string, date string, score double")
    want = lambda **k: {r["id"] for r in frame.filter(retrieval.Filters(**k).condition(frame.columns)).collect()}
    assert want(equal=(("product", "LOAN"),)) == {"a", "b"} and want(date_from="2020-01-01") == {"a", "c"} and want(topic_id=3) == set() and want() == {"a", "b", "c"}
    assert [(r["rank"], r["id"]) for r in retrieval.top(frame, "id", 3, 0.05).collect()] == [(1, "a"), (2, "b")]
    assert retrieval.top(frame.limit(0), "id", 3).count() == 0
    for bad in (("", 5, 0.5), ("x", 0, 0.5), ("x", 51, 0.5), ("x", 5, 1.5)):
        with pytest.raises(ValueError):
            retrieval.check_request(*bad)


def test_topics_find_what_was_mixed(spark):
    rows = [(i, ["red", "green", "blue"][i % 3]) for i in range(60)]
    words = {"red": "rose ruby brick", "green": "leaf moss fern", "blue": "sky sea ink"}
    frame = spark.createDataFrame([(i, words[c]) for i, c in rows], "id int, body string")
    counts = text.term_counts(frame, "id", "body")
    vocabulary = text.vocabulary(counts, 60)
    terms = topics.numbered(vocabulary.select("term"))
    sparse = topics.rows_of(text.weights(counts, vocabulary, "id"), terms, "id")
    names = [r["term"] for r in terms.orderBy("place").collect()]
    h = topics.factorise(sparse, len(names), 3, rounds=20)
    found = {r["id"]: r["topic_label"] for r in topics.assign(sparse, "id", h, topics.labels(h, names, 3)).collect()}
    told = {c: {frozenset(found[i].split(" / ")) for i, d in rows if d == c} for c in words}
    assert told == {c: {frozenset(w.split())} for c, w in words.items()}


def test_sources(spark, tmp_path):
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("rows.csv", 'id,body\n1,"two\nlines, ""quoted"""\n2,\n')
    rows = zipped.read_csv(spark, str(archive), ["id", "body"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"'), ("2", "")]
    with pytest.raises(ValueError):
        zipped.read_csv(spark, str(archive), ["id", "other"])
    with pytest.raises(FileNotFoundError):
        tables.register(spark, {"nothing": str(tmp_path / "none")})
    response = {"aggregations": {"product": {"doc_count": 9, "product": {"buckets": [{"key": "a", "doc_count": 3}], "sum_other_doc_count": 1}}}}
    found = tables.aggregation_buckets(spark.createDataFrame([("2020-01", json.dumps(response)), ("2020-02", "{}")], "month string, j string"), "j", ["product", "state"]).collect()
    assert [tuple(r) for r in found] == [("2020-01", "product", "a", 3, 1, 0)]
    tables.write_json_lines(spark.range(3).withColumn("a", F.lit("x")), str(tmp_path / "lines"))
    assert sorted(r.asDict()["id"] for r in tables.records(spark, str(tmp_path / "lines"), "a string, id long").collect()) == [0, 1, 2]
    tables.write_csv(spark.range(9), str(tmp_path / "csv"), first=2)
    assert tables.text_csv(spark, str(tmp_path / "csv")).count() == 2
    assert json.loads(tables.receipt_json(spark.range(1).agg(F.count(F.lit(1)).alias("n")), seed=42)) == {"n": 1, "seed": 42}


def test_paged_source(spark, tmp_path):
    for part in ("a", "b"):
        (tmp_path / f"{part}.jsonl").write_text("\n".join(json.dumps({"id": f"{part}{i:03d}", "v": i}) for i in range(250)))
    spark.dataSource.register(PagedRecords)
    reader = spark.read.format("paged_records").schema("id string, v long").option("key", "id").option("page_size", 100)
    parts = ",".join(str(tmp_path / f"{p}.jsonl") for p in "ab")
    assert reader.option("parts", parts).load().agg(F.count_distinct("id")).first()[0] == 500
    assert reader.option("parts", parts).option("limit", 120).load().count() == 240


def test_catalog_and_stream(spark, tmp_path):
    from loomset.streaming import monthly

    assert {m["name"] for m in catalog.metric_catalog()} >= {"timely_rate", "relief_rate"}
    rows = [(f"2024-01-{d:02d} 10:00:00", "view" if d % 2 else "buy", 1.0) for d in (1, 1, 2, 3, 9)]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, "t string, kind string, value double").select(F.to_timestamp("t").alias("ts"), "kind", "value").write.parquet(source)
    stream = monthly.event_stream(spark, source, "ts timestamp, kind string, value double")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        query = monthly.to_table(monthly.daily_counts(stream, "ts", "kind"), out, str(tmp_path / "progress"))
        query.awaitTermination(120)
    found = {(str(r["day"]), r["kind"]): r["event_count"] for r in spark.read.parquet(out).collect()}
    assert found[("2024-01-01", "view")] == 2 and ("2024-01-09", "view") not in found


def test_cases_hold_terms_within_one_result_and_collect_no_texts(spark):
    results = spark.createDataFrame([("a", "x", "c", "The late"), ("a", "x", None, "reply came"), ("b", "x", "c", "Late reply"), ("b", "y", "c", ""), ("d", "x", "c", None), ("e", "x", "c", "late")], "case_id string, product string, citation string, chunk_text string")
    cases = spark.createDataFrame([("a", "x", ["late reply"]), ("b", "x", ["LATE", "reply"]), ("c", "x", ["late"]), ("c", "x", []), ("d", "x", []), ("e", "x", ["late", "reply"]), ("e", "x", None)], "case_id string, product string, expected_terms array<string>")
    found = evaluate.retrieval_cases(results, cases)
    rows = sorted((r["case_id"], r["results"], r["filtered"], r["cited"], r["covered"]) for r in found.collect())
    assert rows == [
        ("a", 2, True, False, False),
        ("b", 2, False, True, True),
        ("c", 0, False, False, False),
        ("c", 0, False, False, True),
        ("d", 1, True, True, True),
        ("e", 1, True, True, False),
        ("e", 1, True, True, False),
    ]
    assert "collect_" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_topics_of_every_document_from_pairs_of_words_without_copies_and_masks(spark):
    kinds = (["red rose xxxx 2019", "rose garden soil", "red rose soil garden"], ["boat sail rope", "sail boat tide xx", "rope boat sail tide"])
    rows = [(i, f"{kinds[i % 2][i // 2 % 3]} w{i}") for i in range(24)] + [(100 + i, "copied words here") for i in range(40)]
    rows += [(200, None), (201, ""), (202, "unheard"), (203, "xxxx 17")]
    found = {r["doc_id"]: r for r in themes.document_topics(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    assert set(found) == {i for i, _ in rows}
    assert all((found[i]["topic_id"], found[i]["topic_label"], found[i]["topic_score"]) == (themes.NO_TOPIC, themes.NO_LABEL, 0.0) for i in (*range(100, 140), *range(200, 204)))
    labels = " / ".join({r["topic_label"] for r in found.values()})
    assert "red rose" in labels and "boat sail" in labels and "xx" not in labels and "2019" not in labels and "copied" not in labels
    assert all(found[i]["topic_id"] >= 0 for i in range(24)) and not {found[i]["topic_id"] for i in range(0, 24, 2)} & {found[i]["topic_id"] for i in range(1, 24, 2)}


def test_preparation_from_records_to_receipt(spark, tmp_path):
    rows = [("1 ", "a long enough text with 212-555-0199 in it " * 3, "p", "03/04/2025", "1"), ("1", "another one " * 10, "q", "03/05/2025", "2"), ("2", "short", "p", "", "3"), ("", "nobody's text " * 9, "p", "03/06/2025", "4"), ("3", " ", "p", "", "5"), ("4", "another one " * 10, "p", "bad", "6")]
    frame = spark.createDataFrame(rows, "`Case ID` string, Narrative string, Product string, `Date received` string, Line string")
    names = {"Case ID": "record_id", "Narrative": "text", "Product": "product", "Date received": "received", "Line": "line"}
    options = {"key": "record_id", "text": "text", "dates": ["received"], "product": "product", "order": "line", "snapshot": "s1", "url": "u", "formats": ["MM/dd/yyyy"]}
    told = prepare.run(spark, frame, names, str(tmp_path / "out"), **options)
    wanted = {"source_rows": 6, "non_empty_rows": 5, "short_rows": 1, "redacted_rows": 1, "duplicate_ids": 1, "written_rows": 2, "exact_duplicate_texts": 0, "received_min": "2025-03-04", "received_max": "2025-03-04", "top_products": "p:2"}
    assert {k: told[k] for k in wanted} == wanted and told["content"]["row_count"] == 2
    written = {r["record_id"]: r for r in spark.read.parquet(str(tmp_path / "out" / "texts")).collect()}
    assert set(written) == {"1", "4"} and written["1"]["month"] == "2025-03" and written["4"]["received"] is None and "[REDACTED_PHONE]" in written["1"]["text"]
    with pytest.raises(ValueError):
        prepare.run(spark, frame.limit(0), names, str(tmp_path / "none"), **options)
    with pytest.raises(ValueError):
        prepare.renamed(frame, {"Missing": "x"})


def test_months_in_the_wrong_order_are_an_error(spark):
    frame = spark.createDataFrame([("2025-03", "2025-01")], "a string, b string")
    with pytest.raises(Exception, match="no month from 2025-03 to 2025-01"):
        sampling.month_sequence(frame, "a", "b").collect()


def test_a_missing_dimension_has_no_buckets(spark):
    body = '{"aggregations": {"p": {"p": {"buckets": [{"key": "x", "doc_count": 3}], "sum_other_doc_count": 1}, "doc_count": 4}}}'
    frame = spark.createDataFrame([("2025-01", body)], "month string, r string")
    found = {r["dimension"]: (len(r["buckets"]), r["sum_other_doc_count"], r["doc_count_error_upper_bound"]) for r in tables.bucket_lists(frame, "r", ["p", "q"]).collect()}
    assert found == {"p": (1, 1, 0), "q": (0, 0, 0)}
    assert [tuple(r) for r in tables.aggregation_buckets(frame, "r", ["p", "q"]).collect()] == [("2025-01", "p", "x", 3, 1, 0)]
