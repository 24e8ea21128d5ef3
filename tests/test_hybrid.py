"""Meters of unlike size in one fit, and shapes refitted per fold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.operators import codebook
from meterloom.plans import hybrid, shapes
from meterloom.session import materialise

START = "2021-01-25"


def test_least_assignment_is_the_best_of_all():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (4, 4), (3, 6), (6, 6)]:
        for _ in range(20):
            cost = rng.normal(size=(n, m))
            got = codebook.least_assignment(cost)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            assert len(set(got.tolist())) == n and cost[np.arange(n), got].sum() == pytest.approx(best)


def test_codes_follow_the_shape_and_not_the_level(spark):
    """Three shapes; each series numbers them in another order and at another level, one lacks a shape."""
    wave = [lambda s: 1 + np.sin(s / 4), lambda s: 1 + np.cos(s / 3), lambda s: 1 + (s > 10)]
    rng, rows = np.random.default_rng(3), []
    for i in range(12):
        order = rng.permutation(3)
        for cluster, shape in enumerate(order[: 2 if i == 5 else 3]):
            rows += [(f"s{i}", "raw", 3, 1, int(cluster), slot, float((10.0**(i % 4)) * (wave[shape](slot) + rng.normal(0, 0.02))), int(shape)) for slot in range(24)]
    df = spark.createDataFrame(rows, "series_id string, variant string, k int, config_id int, cluster int, slot int, value double, shape int")
    codes = codebook.align_codebook(df.drop("shape"))
    seen = codes.join(df.select("series_id", "cluster", "shape").distinct(), ["series_id", "cluster"]).select("code", "shape").distinct().collect()
    assert len(seen) == 3 and len({r["code"] for r in seen}) == 3


def _wmape(panel, models):
    s = shapes.shape_days(panel, ks=(2,), configs=[1], variants=("filter",))
    scaled = hybrid.scaled_per_fold(hybrid.holdout_folds(hybrid.day_table(panel), START).filter("variant = 'filter'"))
    predicted = materialise(hybrid.predict_with_models(scaled, s.labels, s.profiles, [("filter", 2, 1)], *models, [0]), "predicted")
    hard = hybrid.score_forecasts(panel, hybrid.forecast_settings(predicted, s.profiles)).collect()
    soft = hybrid.score_forecasts(panel, hybrid.forecast_settings(predicted, s.profiles, soft=True)).collect()
    return {r["series_id"]: r["wmape_signed"] for r in hard}, {r["series_id"]: r["wmape_signed"] for r in soft}


def test_a_meter_a_hundred_times_larger_shares_a_fit(twin):
    big = F.when(F.col("series_id") == "m2", 100.0).otherwise(1.0)
    panel = materialise(twin.withColumns({c: F.col(c) * big for c in ("total", "total_filter")}), "scaled-twin")
    models = [("CART", {"max_depth": 4})], [("Linear Regression", {"reg_type": "ridge", "alpha": 1.0})]
    hard, soft = _wmape(panel, models)
    assert len(hard) == 3
    for m in ("m1", "m2", "m3"):
        alone, alone_soft = _wmape(panel.filter(F.col("series_id") == m), models)
        assert abs(hard[m] - alone[m]) < 2 and abs(soft[m] - alone_soft[m]) < 2, (m, hard, alone)


def test_a_test_day_cannot_change_its_own_profile(twin):
    folded = materialise(hybrid.cv_folds(hybrid.day_table(twin), 2), "folded")
    tested = materialise(folded.filter("role = 'test' AND fold = 1").select("series_id", "date").distinct(), "tested")
    odd = twin.withColumn("date", F.to_date("ts")).join(tested.withColumn("hit", F.lit(True)), ["series_id", "date"], "left")
    changed = materialise(odd.withColumns({c: F.when(F.col("hit"), 50 - F.col(c) * 3).otherwise(F.col(c)) for c in ("total", "total_filter")}).drop("date", "hit"), "changed")
    kept = []
    for panel in (twin, changed):
        s = shapes.shape_days_per_fold(panel, folded, ks=(2,), configs=[1])
        assert s.labels.join(folded.filter("role = 'test'"), ["series_id", "variant", "fold", "date"], "left_semi").count() == 0
        kept.append({tuple(r[c] for c in ("series_id", "variant", "cluster", "slot")): r["value"] for r in s.profiles.filter("fold = 1").collect()})
    assert kept[0].keys() == kept[1].keys() and len(kept[0]) == 3 * 2 * 2 * 96
    assert max(abs(kept[0][k] - kept[1][k]) for k in kept[0]) < 1e-12
    scaled = hybrid.scaled_per_fold(folded)
    scores = hybrid.score_forecasts(twin, hybrid.forecast_settings(hybrid.predict_per_series(scaled, s.labels, 2), s.profiles)).collect()
    assert len(scores) == 3 * 2 * 2 and all(r["mae"] is not None for r in scores)
    pooled = hybrid.predict_with_models(scaled, s.labels, s.profiles, [("filter", 2, 1)], [("CART", {})], [("CART", {})], [1, 2])
    assert hybrid.score_forecasts(twin, hybrid.forecast_settings(pooled, s.profiles)).count() == 3 * 2
