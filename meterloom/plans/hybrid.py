"""Forecast of a day as cluster mean profile x predicted peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterloom.functions.timeaxis import stamp_from
from meterloom.learners import closedform, models
from meterloom.operators import codebook, daily, folds, metrics
from meterloom.operators.reshape import as_variants
from meterloom.operators.scale import standardise
from meterloom.session import materialise, run_parallel

KEYS = ("series_id",)


def shape_times_peak(days: DataFrame, profiles: DataFrame, keys: Sequence[str] = KEYS, span: DataFrame | None = None) -> DataFrame:
    """Hard forecast. ``days``: keys, date, cluster, peak; ``profiles``: keys, cluster, slot, value.

    Profiles are kept on the min-max scale, so the product does not restore the series minimum. ``span`` (keys, lo, hi)
    switches to the algebraic inverse of that scaling for the given peak: lo + value * (peak - lo).
    """
    out = days.join(profiles, [*keys, "cluster"])
    if span is None:
        value = F.col("value") * F.col("peak")
    else:
        out = out.join(span.select(*keys, "lo"), list(keys))
        value = F.col("lo") + F.col("value") * (F.col("peak") - F.col("lo"))
    return out.select(*[c for c in days.columns if c not in ("cluster", "peak")], stamp_from("date", "slot").alias("ts"), value.alias("predicted"))


def blended_profile_times_peak(days: DataFrame, profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Soft forecast. ``days``: keys, date, probs (array by class label), peak. Every cluster's profile counts with its
    probability. A slot that is missing in one of the profiles is missing in the blend."""
    spread = days.select(*[c for c in days.columns if c != "probs"], F.posexplode("probs").alias("cluster", "p"))
    rows = spread.join(profiles, [*keys, "cluster"])
    keep = [c for c in days.columns if c not in ("probs", "peak")]
    return rows.groupBy(*keep, "slot").agg((F.sum(F.col("p") * F.col("value")) * F.max("peak")).alias("predicted")).select(
        *keep, stamp_from("date", "slot").alias("ts"), "predicted"
    )


def pair_with_actual(panel: DataFrame, forecast: DataFrame, target: str = "total", keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join of actual and forecast on the stamp."""
    return forecast.join(panel.select(*keys, "ts", F.col(target).alias("actual")), [*keys, "ts"])


# ---- full runs over settings and model pairs ---------------------------------------------------------------------

DAY = ["fold", "series_id", "variant", "date"]


def day_table(panel: DataFrame, trailing: bool = True, holidays: DataFrame | None = None) -> DataFrame:
    """Unscaled day features with one row per series, load variant and day; ``peak`` is the day's maximum."""
    days = daily.day_features(panel, trailing, holidays=holidays, scale=False, extra={"filter_max": F.max("total_filter")})
    return days.unpivot(["series_id", "date", *daily.feature_columns(trailing)], ["load_max", "filter_max"], "variant", "peak").withColumn(
        "variant", F.when(F.col("variant") == "load_max", "raw").otherwise("filter")
    )


def holdout_folds(days: DataFrame, test_start: str) -> DataFrame:
    """A single fold: days before ``test_start`` train, the others test."""
    return folds.date_split(days, test_start).withColumn("fold", F.lit(0))


def cv_folds(days: DataFrame, splits: int = 2, protocol: str = "complement") -> DataFrame:
    """``complement`` trains on every day outside the test block, ``expanding`` only on the days before it."""
    indexed = folds.with_day_index(days, ["series_id", "variant"])
    split = folds.complement_roles if protocol == "complement" else folds.expanding_roles
    return split(indexed, splits).drop("rn", "series_rows")


def scaled_per_fold(folded: DataFrame, trailing: bool = True, fit_scope: str = "train") -> DataFrame:
    """Climate columns standardised with the statistics of each fold's training days (or of all its days)."""
    climate = daily.CLIMATE + (daily.TRAILING if trailing else [])
    fit = F.col("role") == "train" if fit_scope == "train" else None
    return standardise(folded, climate, ["series_id", "variant", "fold"], fit)


def _complete(df: DataFrame, trailing: bool) -> DataFrame:
    """Days with a missing feature (for example days without readings) cannot be used by a learner."""
    return models.assemble(df, daily.feature_columns(trailing))


def _by_fold(table: DataFrame, keys: Sequence[str]) -> list[str]:
    """``keys`` and the fold, where labels or profiles were fitted per fold."""
    return [*keys, "fold"] if "fold" in table.columns else list(keys)


def predict_with_models(
    scaled: DataFrame, labels: DataFrame, profiles: DataFrame, settings: Sequence[tuple[str, int, int]], classifiers: Sequence[tuple[str, dict]],
    regressors: Sequence[tuple[str, dict]], fold_ids: Sequence[int], trailing: bool = True,
) -> DataFrame:
    """Predicted cluster, class probabilities and peak of every test day for all pairs of models.

    One fit per (setting, fold, classifier) and one per (variant, fold, regressor) over the days of all series; pairs
    are formed by a join of the two prediction tables and cost no further fit. ``settings`` lists (variant, k, config).

    Meters of any size share a fit: classifiers learn codes of a codebook that the clusters of all series are aligned to by
    their ``profiles``, and regressors learn the peak as a ratio to the mean peak of the series' training days. Both are
    turned back per series.
    """
    setting = ["variant", "k", "config_id"]
    level = scaled.filter("role = 'train'").groupBy(*DAY[:3]).agg(F.avg("peak").alias("level"))
    sized = scaled.join(level, DAY[:3]).withColumn("ratio", F.col("peak") / F.nullif(F.col("level"), F.lit(0.0)))
    table = materialise(_complete(sized, trailing).select(*DAY, "role", "features", "ratio", "level"), "day-matrix", ["variant", "fold"])
    codes = codebook.align_codebook(profiles, _by_fold(profiles, setting))
    model = _by_fold(profiles, ["series_id", *setting])
    # One short array per model: the code of each of its clusters.
    slots = F.sequence(F.lit(0), F.max("cluster"))
    books = codes.groupBy(*model).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "code"))).alias("_m"), slots.alias("_s"))
    books = materialise(books.select(*model, F.transform("_s", lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(-1))).alias("codes")), "codes-by-model")
    known = labels.select(*_by_fold(labels, ["series_id", *setting]), "date", "cluster").join(codes, [*model, "cluster"])
    known = materialise(known, "labels", setting)

    def classify(variant, k, config, fold, name, params):
        def here(t: DataFrame) -> DataFrame:
            t = t.filter((F.col("variant") == variant) & (F.col("k") == k) & (F.col("config_id") == config))
            return t.filter(F.col("fold") == fold) if "fold" in t.columns else t

        days = table.filter((F.col("variant") == variant) & (F.col("fold") == fold))
        own = here(known).select("series_id", "date", F.col("code").cast("double").alias("label"))
        train = days.filter("role = 'train'").join(own, ["series_id", "date"])
        scored = models.fit_classifier(name, params, train, k).transform(days.filter("role = 'test'")).withColumnsRenamed({"probs": "_probs", "prediction": "_code"})
        back = scored.join(here(books).select("series_id", "codes"), "series_id")
        by_cluster = F.transform("codes", lambda c: F.coalesce(F.get("_probs", c), F.lit(0.0)))
        likeliest = -F.array_max(F.transform(by_cluster, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))["i"]
        place = F.array_position("codes", F.col("_code").cast("int")) - 1
        # A code that the series has no cluster for gives way to the likeliest one it has.
        return back.select(*DAY, F.lit(k).alias("k"), F.lit(config).alias("config_id"), F.lit(name).alias("classifier"),
                           F.when(place >= 0, place).otherwise(likeliest).cast("int").alias("cluster"), by_cluster.alias("probs"))

    def regress(variant, fold, name, params):
        days = table.filter((F.col("variant") == variant) & (F.col("fold") == fold)).withColumn("label", F.col("ratio"))
        train = days.filter("role = 'train' AND label IS NOT NULL")
        scored = models.fit_regressor(name, params, train).transform(days.filter("role = 'test'"))
        return scored.select(*DAY, F.lit(name).alias("regressor"), (F.col("prediction") * F.col("level")).alias("peak"))

    variants = sorted({v for v, _, _ in settings})
    shapes = run_parallel([(lambda a=(*s, f, *c): classify(*a)) for s in settings for f in fold_ids for c in classifiers])
    peaks = run_parallel([(lambda a=(v, f, *r): regress(*a)) for v in variants for f in fold_ids for r in regressors])
    return _union(shapes).join(_union(peaks), DAY)


def predict_per_series(scaled: DataFrame, labels: DataFrame, n_classes: int, alpha: float = 1.0, var_smoothing: float = 1e-9, trailing: bool = True) -> DataFrame:
    """The same table from closed-form learners fitted for every series, setting and fold in one plan, without loops:
    Gaussian naive Bayes for the shape and ridge regression for the peak."""
    features = daily.feature_columns(trailing)
    days = materialise(scaled.dropna(subset=features).select(*DAY, "role", "peak", *features), "day-features")
    model = [*DAY[:3], "config_id", "k"]
    keys = _by_fold(labels, ["series_id", "variant"])
    own = labels.select(*keys, "config_id", "k", "date", "cluster")
    train = days.filter("role = 'train'")
    test = days.filter("role = 'test'")
    bayes = closedform.bayes_fit(train.join(own, [*keys, "date"]), features, "cluster", model, var_smoothing)
    runs = own.select(*keys, "config_id", "k").distinct()
    shapes = closedform.bayes_predict(test.join(runs, keys), bayes, features, n_classes, model)
    shapes = shapes.select(*DAY, "config_id", "k", F.col("prediction").alias("cluster"), "probs")
    ridge = closedform.linear_fit(train, features, "peak", DAY[:3], alpha)
    peaks = closedform.linear_predict(test, ridge, features, DAY[:3], "predicted_peak")
    return shapes.join(peaks.select(*DAY, F.col("predicted_peak").alias("peak")), DAY).withColumns({"classifier": F.lit("Naive Bayes"), "regressor": F.lit("Linear Regression")})


def forecast_settings(predicted: DataFrame, profiles: DataFrame, soft: bool = False) -> DataFrame:
    """Quarter-hour forecast of every predicted day, for all settings, folds and model pairs at once."""
    keys = _by_fold(profiles, ["series_id", "variant", "config_id", "k"])
    if soft:
        return blended_profile_times_peak(predicted.drop("cluster"), profiles, keys)
    return shape_times_peak(predicted.drop("probs"), profiles, keys)


RUN = ["fold", "variant", "k", "config_id", "classifier", "regressor"]


def score_forecasts(panel: DataFrame, forecast: DataFrame) -> DataFrame:
    """Measures of every run per series against the load variant it was made for."""
    actual = as_variants(panel).withColumnRenamed("value", "actual")
    pairs = forecast.join(actual, ["series_id", "variant", "ts"])
    return metrics.hybrid_metrics(pairs, ["series_id", *RUN])


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over the folds of each run."""
    return metrics.cv_summary(scores, ["series_id", *[c for c in RUN if c != "fold"]], ["r2", "mae", "mse", "rmse", "wmape_signed"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
