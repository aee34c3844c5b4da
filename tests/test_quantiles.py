"""Selected quantiles against sorted values, with ties, few values, and a sketch that is wrong."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import quality, quantiles, retrieval

SHARES = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]


def plain(values, shares):
    held = sorted(x for x in values if x is not None and not math.isnan(x))
    return [float(np.quantile(held, p)) if held else None for p in shares]


def draws(kind, n, rng):
    return {
        "normal": lambda: [rng.gauss(0, 1) for _ in range(n)],
        "few": lambda: [float(rng.randint(0, 3)) for _ in range(n)],
        "hot": lambda: [7.0 if rng.random() < 0.6 else rng.random() * 20 for _ in range(n)],
        "wide": lambda: [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
        "same": lambda: [4.5] * n,
        "odd": lambda: [rng.choice([None, float("nan"), 1.0, float("inf"), -float("inf"), 2.0]) for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("kind", ["normal", "few", "hot", "wide", "same", "odd"])
def test_quantiles_against_sorted_values(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    values = draws(kind, 3000, random.Random(kind))
    shares = [0.0, 0.3, 1.0] if kind == "odd" else SHARES
    found = quantiles.quantiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(5), "v", shares)
    held = sorted(x for x in values if x is not None and not math.isnan(x))
    expected = [held[math.floor(p * (len(held) - 1))] for p in shares] if kind == "odd" else plain(values, shares)
    for a, b in zip(found, expected, strict=True):
        assert a == b or math.isclose(a, b, rel_tol=1e-12) or kind == "odd" and math.isnan(a), (kind, found, expected)


def test_quantiles_of_few_values(spark):
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]
    assert quantiles.quantiles(spark.createDataFrame([(3,), (None,)], "v int"), "v", [0.0, 0.5, 1.0]) == [3.0, 3.0, 3.0]
    with pytest.raises(ValueError):
        quantiles.quantiles(spark.createDataFrame([(3,)], "v int"), "v", [1.5])


def test_a_wrong_sketch_changes_nothing(spark, monkeypatch):
    """Whatever two values of the interval the sketch gives, the counts lead to the rank."""
    monkeypatch.setattr(quantiles, "SMALL", 5)
    rng = random.Random(3)
    values = [float(rng.randint(0, 400)) for _ in range(1500)]
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, a: real(c, F.array(F.lit(0.6), F.lit(0.8)), a))
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert quantiles.quantiles(frame, "v", [0.1, 0.5, 0.9]) == plain(values, [0.1, 0.5, 0.9])


def test_no_task_gets_the_column(spark, monkeypatch):
    """Nothing is sorted or shuffled but one row a task."""
    frame = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    plans = []
    real = quantiles._round

    def spied(rows, x, sought):
        plans.append(rows.agg(F.percentile_approx(x, 0.5, 100))._jdf.queryExecution().executedPlan().toString())
        real(rows, x, sought)

    monkeypatch.setattr(quantiles, "_round", spied)
    assert quantiles.quantiles(frame, "v", [0.5]) == plain([r[0] for r in frame.collect()], [0.5])
    assert plans and all("partial_percentile_approx" in p and "Sort" not in p for p in plans)


def test_lag_stats_without_lags(spark):
    frame = spark.createDataFrame([], "a timestamp_ntz, b timestamp_ntz")
    assert quality.lag_stats(frame, "a", "b").first()["median_days"] is None


def test_a_document_is_looked_up_by_a_pushed_value(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("t"), "id").alias("chunk_text")).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    found = retrieval.document(chunks, "doc_id", "7")
    assert found.first()["texts"] == ["t7"] and "EqualTo(doc_id,7)" in found._jdf.queryExecution().executedPlan().toString()
    assert [retrieval.document(chunks, "doc_id", x).count() for x in ("007", "x", "700", 8)] == [0, 0, 0, 1]
