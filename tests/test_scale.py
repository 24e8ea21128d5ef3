"""Operators that must not put a group, a second or a series into one task: equal to their plain forms."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.learners import closedform
from meterloom.operators import metrics, validity
from meterloom.plans import evaluation
from meterloom.session import scratch_path
from meterloom.sources import artefacts


@pytest.mark.parametrize("tile", [7, 40, 5000])
def test_silhouette_by_tiles(spark, tile):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for model, (n, k) in enumerate([(90, 3), (30, 2), (1, 1), (12, 12), (20, 1), (25, 4)]):
        x = rng.normal(size=(n, 3)) + (np.arange(n) % k)[:, None] * 2.0
        own = np.where(np.arange(n) == 0, k - 1, np.arange(n) % k) if k < n else np.arange(n)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for i in range(n):
            mine = own == own[i]
            value = 0.0
            if 1 < len(set(own)) < n and mine.sum() > 1:
                a = d[i, mine].sum() / (mine.sum() - 1)
                b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
                value = (b - a) / max(a, b)
            want[model, i] = value
            rows.append((model, i, int(own[i]), x[i].tolist()))
    df = spark.createDataFrame(rows, "m int, point int, cluster int, vec array<double>")
    got = {(r["m"], r["point"]): r["silhouette"] for r in validity.silhouette_points(df, ["m"], ["point"], tile).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_diagnostics_without_pairs(spark):
    rng = np.random.default_rng(5)
    stamps = [f"2021-01-0{1 + i % 3} 00:00:0{i % 7}.{i % 10}00" for i in range(400)] + ["2021-01-05 00:00:00.500"] * 300
    load = [(f"m{i % 2}", s, None if i % 17 == 0 else 0.0 if i % 13 == 0 else float(1e6 + rng.integers(0, 9))) for i, s in enumerate(stamps)]
    forecast = [(f"m{i % 2}", s, None if i % 11 == 0 else float(1e6 + rng.integers(0, 9))) for i, s in enumerate(stamps[::-1])] + [("m0", None, 1.0), ("m9", stamps[0], 2.0)]
    a = spark.createDataFrame(load, "series_id string, ts string, actual double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    f = spark.createDataFrame(forecast, "series_id string, ts string, predicted double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    pairs = evaluation.align_by_second(a, f)
    want = {r["series_id"]: r.asDict() for r in metrics.full_diagnostics(pairs, ["series_id"]).collect()}
    got = {r["series_id"]: r.asDict() for r in evaluation.diagnostics_by_second(a, f).collect()}
    assert got.keys() == want.keys() == {"m0", "m1"} and pairs.count() > 20_000
    for m in want:
        for c, v in want[m].items():
            assert got[m][c] == (v if c == "series_id" else pytest.approx(v, rel=1e-6, abs=1e-6)), (m, c)
    none = evaluation.diagnostics_by_second(a, f.filter("false"))
    assert none.count() == 0 and none.columns == metrics.full_diagnostics(pairs, ["series_id"]).columns


def test_lasso_meets_its_optimality_conditions(spark, twin):
    days = twin.groupBy("series_id", F.to_date("ts").alias("date")).agg(F.max("total").alias("y"), F.avg("temperature").alias("a"), F.avg("radiation").alias("b"))
    cols = ["a", "b", "c", "d", "e", "k"]
    days = days.withColumns({"c": F.sin(F.dayofyear("date")), "d": F.col("a") * 2 - 1, "e": F.col("a") * F.col("b") / 100, "k": F.lit(3.0)})
    rows = days.toPandas()
    alphas = [1e-7, 0.001, 0.05, 0.4, 50.0]
    got = closedform.lasso_fit(days, cols, "y", alphas).collect()
    assert len(got) == 3 * len(alphas)
    for r in got:
        own = rows[rows["series_id"] == r["series_id"]]
        x, y = own[cols].to_numpy(float), own["y"].to_numpy(float)
        x, y = x - x.mean(0), y - y.mean()
        w = np.array(r["coef"])
        gradient = x.T @ (y - x @ w) / len(y)
        missed = np.where(w != 0, np.abs(gradient - r["alpha"] * np.sign(w)), np.maximum(np.abs(gradient) - r["alpha"], 0))
        assert missed.max() < 1e-6 and r["missed"] < 1e-6 and w[5] == 0
        assert r["alpha"] < 50 or not w.any()


def test_a_series_with_most_of_the_rows_is_written_by_several_tasks(spark):
    rows = spark.range(400_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 50)).otherwise("hot").alias("series_id"), F.lit("raw").alias("variant"), F.rand(1).alias("value"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        path = artefacts.write_keyed(rows, scratch_path(spark, "hot"), ["variant"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) >= 4
    assert artefacts.read_keyed(spark, path, variant="raw").count() == 400_000
