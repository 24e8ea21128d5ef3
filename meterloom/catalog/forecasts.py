"""Shape x peak forecasts from given labels and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.registry import register
from meterloom.catalog.tables import TEST_START, day_labels, det_profiles, panel
from meterloom.operators import daily
from meterloom.plans import hybrid, shapes
from meterloom.session import materialise
from meterloom.sources import panels


def preds_det(spark, sf):
    """Predicted peak: the previous day's maximum. Predicted cluster: the label seven days earlier."""
    days = daily.day_base(panels.events_panel(spark, sf)).select("series_id", "date", "load_max")
    before = days.select("series_id", F.date_add("date", 1).alias("date"), F.col("load_max").alias("peak"))
    labels = day_labels(spark, sf).select("series_id", F.date_add("date", 7).alias("date"), "cluster")
    return days.select("series_id", "date").join(before, ["series_id", "date"]).join(labels, ["series_id", "date"])


def hard_forecast(spark, sf):
    return hybrid.shape_times_peak(preds_det(spark, sf), det_profiles(spark, sf))


def hard_pairs(spark, sf):
    return hybrid.pair_with_actual(panels.events_panel(spark, sf), hard_forecast(spark, sf))


@register("k22_hard_forecast", "series_id ts:t predicted:6", "SELECT series_id, ts, predicted FROM hard_forecast")
def k22(spark, sf):
    return hard_forecast(spark, sf)


@register("k22_rescaled_forecast", "series_id ts:t predicted:6",
          """SELECT p.series_id, CAST(p.date AS TIMESTAMP) + to_minutes(CAST(f.slot * 15 AS INT)) AS ts, m.lo + f.value * (p.peak - m.lo) AS predicted
             FROM preds_det p JOIN profiles f ON f.series_id = p.series_id AND f.cluster = p.cluster JOIN (SELECT series_id, min(total) AS lo FROM load15 GROUP BY 1) m ON m.series_id = p.series_id""")
def k22_inverse(spark, sf):
    span = panels.events_panel(spark, sf).groupBy("series_id").agg(F.min("total").alias("lo"))
    return hybrid.shape_times_peak(preds_det(spark, sf), det_profiles(spark, sf), span=span)


@register("k23_soft_forecast", "series_id ts:t predicted:6",
          """SELECT p.series_id, CAST(p.date AS TIMESTAMP) + to_minutes(CAST(f.slot * 15 AS INT)) AS ts, sum(CASE WHEN f.cluster = p.cluster THEN 0.6 ELSE 0.2 END * f.value) * any_value(p.peak) AS predicted
             FROM preds_det p JOIN profiles f ON f.series_id = p.series_id GROUP BY 1, 2""")
def k23(spark, sf):
    probs = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("cluster"), F.lit(0.6)).otherwise(F.lit(0.2)))
    days = preds_det(spark, sf).withColumn("probs", probs).drop("cluster")
    return hybrid.blended_profile_times_peak(days, det_profiles(spark, sf))


def _stage(spark, sf, ks, configs, variants):
    p = materialise(panel(spark, sf), "panel")
    return p, shapes.shape_days(p, ks, configs, variants)


_SCORES = "series_id fold:i variant k:i config_id:i classifier regressor r2:6 mae:6 mse:6 rmse:6 wmape_signed:6"


@register("k24_hybrid_holdout", _SCORES)
def k24(spark, sf):
    p, s = _stage(spark, sf, [2], [1], ["filter"])
    scaled = hybrid.scaled_per_fold(hybrid.holdout_folds(hybrid.day_table(p), TEST_START))
    predicted = hybrid.predict_with_models(
        scaled, s.labels, s.profiles, [("filter", 2, 1)], [("Logistic Regression", {"C": 1.0}), ("CART", {"max_depth": 4})],
        [("Linear Regression", {"reg_type": "ridge", "alpha": 1.0}), ("CART", {"max_depth": 4})], [0])
    return hybrid.score_forecasts(p, hybrid.forecast_settings(predicted, s.profiles))


@register("k24_hybrid_all_settings_per_series", _SCORES)
def k24_series(spark, sf):
    p, s = _stage(spark, sf, [2, 3], None, ["raw", "filter"])
    scaled = hybrid.scaled_per_fold(hybrid.holdout_folds(hybrid.day_table(p), TEST_START))
    predicted = hybrid.predict_per_series(scaled, s.labels, 3)
    return hybrid.score_forecasts(p, hybrid.forecast_settings(predicted, s.profiles))


@register("k24_hybrid_soft_per_series", _SCORES)
def k24_soft(spark, sf):
    p, s = _stage(spark, sf, [3], [1, 2], ["filter"])
    scaled = hybrid.scaled_per_fold(hybrid.holdout_folds(hybrid.day_table(p), TEST_START))
    predicted = hybrid.predict_per_series(scaled, s.labels, 3).filter("variant = 'filter'")
    return hybrid.score_forecasts(p, hybrid.forecast_settings(predicted, s.profiles, soft=True))


_MEANS = " ".join(f"{m}_{s}:6" for m in ("r2", "mae", "mse", "rmse", "wmape_signed") for s in ("mean", "std"))


@register("k25_hybrid_cross_validation", "series_id variant k:i config_id:i classifier regressor " + _MEANS)
def k25(spark, sf):
    p, s = _stage(spark, sf, [2, 3], [1, 2], ["filter"])
    scaled = hybrid.scaled_per_fold(hybrid.cv_folds(hybrid.day_table(p), 2))
    predicted = hybrid.predict_per_series(scaled, s.labels, 3).filter("variant = 'filter'")
    return hybrid.cv_summary(hybrid.score_forecasts(p, hybrid.forecast_settings(predicted, s.profiles)))
