"""What the SQL gateway takes, refuses and stops."""

import time

import pytest
from pyspark.sql import functions as F

from loomset.operators import gateway


@pytest.fixture(scope="module")
def views(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("views")
    spark.range(100_000).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("name"), "id").alias("name")).write.parquet(str(folder / "big"))
    spark.range(5).select("id", F.concat(F.lit("n"), "id").alias("name")).write.parquet(str(folder / "few"))
    return {"big": str(folder / "big"), "few": str(folder / "few")}


TAKEN = {
    "SELECT * FROM few, LATERAL explode(array(1, 2)) t(x)": 10,
    "FROM few |> WHERE id > 1 |> SELECT name": 3,
    "SELECT * FROM range(10)": 10,
    "SELECT * FROM few LATERAL VIEW explode(sequence(1, 5)) v AS x": 25,
    "SELECT explode(sequence(date'2024-01-01', date'2024-12-01', interval 1 month)) AS month": 12,
    "SELECT a.id FROM big a JOIN big b ON a.id = b.id": 200,
    "SELECT a.id FROM few a CROSS JOIN few b": 25,
    "SELECT a.id FROM big a CROSS JOIN few b": 200,
    "SELECT k, count(*) AS n FROM big GROUP BY CUBE (k, name) ORDER BY n DESC": 200,
    "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT * FROM t": 20,
    "SELECT lpad(name, 9, '0') AS p, repeat('x', 3) AS r FROM few": 5,
    "SELECT id FROM few WHERE id IN (SELECT k FROM big)": 5,
}
REFUSED = [
    "SELECT * FROM range(1000000000000)", "SELECT * FROM range(0, 1000000000000)", "SELECT * FROM range(0, 10000000, 2)", "SELECT explode(sequence(1, 1000000000))", "SELECT * FROM few LATERAL VIEW explode(sequence(1, 100000000)) v AS x",
    "SELECT * FROM explode(sequence(1, 1000000000))", "SELECT explode(sequence(0, id)) FROM big", "SELECT repeat('x', 2000000000)", "SELECT array_repeat(1, 1000000000)", "SELECT rpad('a', 1000000000, 'b')", "SELECT space(1000000000)",
    "SELECT count(*) FROM big a CROSS JOIN big b CROSS JOIN big c", "SELECT count(*) FROM big a JOIN big b ON a.id < b.id JOIN big c ON a.id < c.id", "SELECT count(*) FROM big a, big b, range(100000) c",
    "SELECT id, (SELECT count(*) FROM big a CROSS JOIN big b CROSS JOIN big c) FROM few", "SELECT * FROM read_files('/etc')", "SELECT * FROM json_tuple('{}', 'a')", "SELECT * FROM few |> INSERT INTO x", "SELECT * FROM system.builtin.range(3)",
]


@pytest.mark.parametrize("sql", TAKEN)
def test_taken(spark, views, sql):
    columns, rows = gateway.collect(spark, sql, views)
    assert len(rows) == TAKEN[sql] and len(columns) >= 1


@pytest.mark.parametrize("sql", REFUSED)
def test_refused_before_anything_runs(spark, views, sql):
    began = time.monotonic()
    with pytest.raises(gateway.NotAllowed):
        gateway.run(spark, sql, views)
    assert time.monotonic() - began < 20


def test_recursion_without_an_end_is_stopped(spark, views):
    with pytest.raises(Exception, match="RECURSION"):
        gateway.collect(spark, "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT max(n) FROM t", views)


def test_a_query_is_interrupted_after_a_time(spark, views):
    slow = "SELECT count(*) AS n FROM big a JOIN big b ON a.name < b.name OR a.k > b.id"
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        gateway.collect(spark, slow, views, seconds=1.0)
    assert time.monotonic() - began < 30
    assert gateway.collect(spark, "SELECT count(*) AS n FROM few", views)[1][0]["n"] == 5  # later queries run


def test_work_allowed_is_a_parameter(spark, views):
    with pytest.raises(gateway.NotAllowed, match="rows"):
        gateway.run(spark, "SELECT * FROM big a CROSS JOIN few b", views, max_work=1000)
    frame = spark.read.parquet(views["big"])
    assert 10_000 < gateway.estimated_rows(frame) < 10_000_000
