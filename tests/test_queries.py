"""Every registered query against its SQL, run by another engine over the same files."""

from pathlib import Path

import pytest

from loomset.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(value):
    return "null" if value is None else repr(round(value, 9)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    connection = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    frame, other = QUERIES[name](spark, data), duck.sql(SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(other.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    places = [list(other.columns).index(c) for c in columns]
    assert found == sorted(tuple(plain(r[i]) for i in places) for r in other.fetchall())


def test_topics_cover_all_documents(spark, data):
    rows = QUERIES["nmf_topics"](spark, data).collect()
    documents = spark.read.parquet(f"{data}/documents.parquet").count()
    assert len({r["doc_id"] for r in rows}) == len(rows) == documents
    assert len({r["topic_label"] for r in rows if r["topic_id"] >= 0}) > 1 and all(r["topic_score"] >= 0 for r in rows)


def test_topic_cube_adds_up_to_its_documents(spark, data):
    rows = QUERIES["topic_cube_from_topics"](spark, data).collect()
    cells = {}
    for r in rows:
        cells.setdefault((r["month"], r["product"]), []).append(r)
    assert sum(r["narrative_count"] for r in rows) == spark.read.parquet(f"{data}/documents.parquet").count()
    for cell in cells.values():
        assert {r["group_month_total"] for r in cell} == {sum(r["narrative_count"] for r in cell)} and abs(sum(r["share"] for r in cell) - 1) < 1e-9


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
