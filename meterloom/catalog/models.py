"""Learners, splits, measures and model selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.features import pairs
from meterloom.catalog.forecasts import hard_pairs
from meterloom.catalog.registry import register
from meterloom.catalog.tables import TEST_START, day_labels, panel
from meterloom.functions.encode import nan_to_null
from meterloom.learners import closedform, models, search, spaces
from meterloom.operators import daily, folds, metrics, ranking
from meterloom.plans import evaluation
from meterloom.session import materialise
from meterloom.sources import panels

_FEATURES = daily.feature_columns(False)
_ALL_FEATURES = daily.feature_columns(True)
_SCALED = lambda cols: ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER s = 0 THEN 0 ELSE ({c} - avg({c}) OVER s) / stddev_pop({c}) OVER s END AS {c}" for c in cols)
_PLAIN = "is_weekend, is_holiday, month_sin, month_cos, weekday_sin, weekday_cos, dayofyear_sin, dayofyear_cos"


def _spec(cols):
    return " ".join(f"{c}:i" if c.startswith("is_") else f"{c}:6" for c in cols)


@register("j0_standard_scaling", "series_id date:d temperature:6 load_max:6 radiation_sum:6",
          f"SELECT series_id, date, {_SCALED(['temperature', 'load_max', 'radiation_sum'])} FROM days WINDOW s AS (PARTITION BY series_id)")
def j0(spark, sf):
    from meterloom.operators.scale import standardise

    return standardise(daily.day_base(panels.events_panel(spark, sf)), ["temperature", "load_max", "radiation_sum"])


@register("j0_scaling_fitted_on_train", "series_id date:d temperature:6 load_max:6",
          """SELECT d.series_id, d.date, (d.temperature - s.tm) / s.td AS temperature, (d.load_max - s.lm) / s.ld AS load_max FROM days d
             JOIN (SELECT series_id, avg(temperature) AS tm, stddev_pop(temperature) AS td, avg(load_max) AS lm, stddev_pop(load_max) AS ld FROM days WHERE date < DATE '2024-01-24' GROUP BY 1) s USING (series_id)""")
def j0_train(spark, sf):
    from meterloom.operators.scale import standardise

    days = daily.day_base(panels.events_panel(spark, sf))
    return standardise(days, ["temperature", "load_max"], fit=F.col("date") < F.lit(TEST_START).cast("date"))


@register("k20_day_classifier_features", "series_id date:d load_max:6 " + _spec(_FEATURES),
          f"SELECT series_id, date, load_max, {_SCALED(['temperature', 'radiation_sum'])}, {_PLAIN} FROM raw_features WINDOW s AS (PARTITION BY series_id)")
def k20(spark, sf):
    return daily.day_features(panels.events_panel(spark, sf))


@register("k21_peak_regressor_features", "series_id date:d load_max:6 " + _spec(_ALL_FEATURES),
          f"SELECT series_id, date, load_max, {_SCALED(daily.CLIMATE + daily.TRAILING)}, {_PLAIN} FROM raw_features WINDOW s AS (PARTITION BY series_id)")
def k21(spark, sf):
    return daily.day_features(panels.events_panel(spark, sf), trailing=True)


@register("b19_re_encoded_features_dropped", "series_id date:d names month_sin:6 weekday_cos:6",
          """SELECT series_id, date, 'dayofyear_cos,dayofyear_sin,is_holiday,is_weekend,month_cos,month_sin,weekday_cos,weekday_sin' AS names,
                    sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS weekday_cos FROM orders_days""")
def b19(spark, sf):
    from meterloom.functions.encode import with_cyclic

    days = panels.orders_panel(spark, sf).select("series_id", "date")
    out = with_cyclic(daily.with_calendar(days))
    return out.withColumn("names", F.lit(",".join(sorted(set(out.columns) - set(days.columns)))))


# ---- learners ----------------------------------------------------------------------------------------------------


def matrix(spark, sf, target: str = "cluster", trailing: bool = False):
    """Stored feature matrix with the given label, split at the test start."""
    cols = daily.feature_columns(trailing)
    days = daily.day_features(panels.events_panel(spark, sf), trailing=trailing, fit=F.col("date") < F.lit(TEST_START).cast("date"))
    if target == "cluster":
        days = days.join(day_labels(spark, sf).drop("cluster2"), ["series_id", "date"]).withColumn("label", F.col("cluster").cast("double"))
    else:
        days = days.withColumn("label", F.col("load_max"))
    table = models.assemble(days, cols).select("series_id", "date", "features", "label").dropna(subset=["label"])
    return folds.date_split(materialise(table, "matrix"), TEST_START)


def _classify(name, params):
    def run(spark, sf):
        m = matrix(spark, sf)
        fitted = models.fit_classifier(name, params, m.filter("role = 'train'"), 3)
        out = fitted.transform(m.filter("role = 'test'"))
        return out.select("series_id", "date", "label", "prediction", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)])

    return run


def _regress(name, params, trailing=True):
    def run(spark, sf):
        m = matrix(spark, sf, "load_max", trailing)
        fitted = models.fit_regressor(name, params, m.filter("role = 'train'"))
        return fitted.transform(m.filter("role = 'test'")).select("series_id", "date", "label", "prediction")

    return run


_CLASS_OUT = "series_id date:d label:i prediction:i p0:6 p1:6 p2:6"
for _id, _name, _over in [
    ("j1_cart_classifier", "CART", {}), ("j2_xgboost_classifier", "XGBoost", {"gamma": 0.0}), ("j3_lightgbm_classifier", "LightGBM", {}),
    ("j4_catboost_classifier", "CatBoost", {}), ("j5_linear_svm", "SVM Linear", {}), ("j6_kernel_svm", "SVM Non-Linear", {"C": 10.0}),
    ("j6_polynomial_svm", "SVM Non-Linear", {"kernel": "poly", "degree": 2}), ("j8_logistic_regression", "Logistic Regression", {"C": 10.0}),
    ("j9_random_forest_classifier", "Random Forest", {"max_depth": 5}), ("j7_naive_bayes_pooled", "Naive Bayes", {}),
]:
    register(_id, _CLASS_OUT)(_classify(_name, {**spaces.middle(spaces.CLASSIFIER_SPACES[_name]), **_over}))
for _id, _name, _over in [
    ("j10_cart_regressor", "CART", {}), ("j11_xgboost_regressor", "XGBoost", {"gamma": 0.0}), ("j12_lightgbm_regressor", "LightGBM", {}),
    ("j13_catboost_regressor", "CatBoost", {}), ("j14_linear_svr", "SVR Linear", {}), ("j15_kernel_svr", "SVR Non-Linear", {"C": 10.0}),
    ("j16_lasso_pooled", "Linear Regression", {"reg_type": "lasso", "alpha": 0.1}), ("j16_ridge_pooled", "Linear Regression", {"reg_type": "ridge"}),
    ("j17_random_forest_regressor", "Random Forest", {"max_depth": 5, "max_features": "all"}),
]:
    register(_id, "series_id date:d label:6 prediction:6")(_regress(_name, {**spaces.middle(spaces.REGRESSOR_SPACES[_name]), **_over}))

_THREE = ["temperature", "load_max", "radiation_sum"]


def _train_test(spark, sf):
    days = daily.day_base(panels.events_panel(spark, sf))
    start = F.lit(TEST_START).cast("date")
    return days, days.filter(F.col("date") < start), days.filter(F.col("date") >= start)


_NB = """WITH tr AS (SELECT d.*, l.cluster FROM days d JOIN labels_det l USING (series_id, date) WHERE d.date < DATE '2024-01-24'),
 w AS (SELECT series_id, count(*) AS n, 1e-9 * greatest(var_pop(temperature), var_pop(load_max), var_pop(radiation_sum)) AS e FROM tr GROUP BY 1),
 c AS (SELECT tr.series_id, cluster, count(*) / any_value(w.n) AS prior, avg(temperature) AS m1, avg(load_max) AS m2, avg(radiation_sum) AS m3,
       var_pop(temperature) + any_value(e) AS v1, var_pop(load_max) + any_value(e) AS v2, var_pop(radiation_sum) + any_value(e) AS v3 FROM tr JOIN w USING (series_id) GROUP BY 1, 2),
 s AS (SELECT d.series_id, d.date, c.cluster, ln(prior) - 0.5 * (ln(2 * pi() * v1) + pow(d.temperature - m1, 2) / v1 + ln(2 * pi() * v2) + pow(d.load_max - m2, 2) / v2
       + ln(2 * pi() * v3) + pow(d.radiation_sum - m3, 2) / v3) AS s FROM days d JOIN c USING (series_id) WHERE d.date >= DATE '2024-01-24'),
 z AS (SELECT series_id, date, cluster, exp(s - max(s) OVER (PARTITION BY series_id, date)) AS w FROM s)
 SELECT series_id, date, arg_max(cluster, w) AS prediction, sum(CASE WHEN cluster = 0 THEN w ELSE 0 END) / sum(w) AS p0,
        sum(CASE WHEN cluster = 1 THEN w ELSE 0 END) / sum(w) AS p1, sum(CASE WHEN cluster = 2 THEN w ELSE 0 END) / sum(w) AS p2 FROM z GROUP BY 1, 2"""


@register("j7_naive_bayes_per_series", "series_id date:d prediction:i p0:6 p1:6 p2:6", _NB)
def j7(spark, sf):
    _, train, test = _train_test(spark, sf)
    labelled = train.join(day_labels(spark, sf).drop("cluster2"), ["series_id", "date"])
    out = closedform.bayes_predict(test, closedform.bayes_fit(labelled, _THREE), _THREE, 3)
    return out.select("series_id", "date", "prediction", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)])


def _ols_sql(alpha: float, target: str = "load_max", value: str = "b0 + b1 * d.temperature + b2 * d.radiation_sum") -> str:
    return f"""WITH t AS (SELECT series_id, temperature AS x, radiation_sum AS z, {target} AS y FROM days WHERE date < DATE '2024-01-24'),
 g AS (SELECT series_id, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, sum(x * x) - count(*) * avg(x) * avg(x) + {alpha} AS xx, sum(z * z) - count(*) * avg(z) * avg(z) + {alpha} AS zz,
   sum(x * z) - count(*) * avg(x) * avg(z) AS xz, sum(x * y) - count(*) * avg(x) * avg(y) AS xy, sum(z * y) - count(*) * avg(z) * avg(y) AS zy FROM t GROUP BY 1),
 b AS (SELECT series_id, mx, mz, my, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM g),
 c AS (SELECT *, my - b1 * mx - b2 * mz AS b0 FROM b)
 SELECT d.series_id, d.date, {value} AS prediction FROM days d JOIN c USING (series_id) WHERE d.date >= DATE '2024-01-24'"""


_TWO = ["temperature", "radiation_sum"]


@register("j16_least_squares_per_series", "series_id date:d prediction:5", _ols_sql(0))
def j16(spark, sf):
    _, train, test = _train_test(spark, sf)
    return closedform.linear_predict(test, closedform.linear_fit(train, _TWO, "load_max"), _TWO)


@register("j16_ridge_per_series", "series_id date:d prediction:5", _ols_sql(10.0))
def j16_ridge(spark, sf):
    _, train, test = _train_test(spark, sf)
    return closedform.linear_predict(test, closedform.linear_fit(train, _TWO, "load_max", alpha=10.0), _TWO)


_LASSO_ALPHAS = (0.01, 0.5, 5.0, 40.0)


def _lasso_sql() -> str:
    """Two features: the optimum is among nine sign patterns, each with a closed form; the least objective wins."""
    alphas = ", ".join(f"({a})" for a in _LASSO_ALPHAS)
    return f"""WITH t AS (SELECT series_id, temperature AS x, radiation_sum AS z, load_max AS y FROM days WHERE date < DATE '2024-01-24'),
 g AS (SELECT series_id, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM t GROUP BY 1),
 c AS (SELECT g.*, a.a, s.s, r.r, CASE WHEN s.s = 0 THEN 0 WHEN r.r = 0 THEN (xy - a.a * s.s) / xx ELSE ((xy - a.a * s.s) * zz - (zy - a.a * r.r) * xz) / (xx * zz - xz * xz) END AS b1,
   CASE WHEN r.r = 0 THEN 0 WHEN s.s = 0 THEN (zy - a.a * r.r) / zz ELSE ((zy - a.a * r.r) * xx - (xy - a.a * s.s) * xz) / (xx * zz - xz * xz) END AS b2
   FROM g, (VALUES {alphas}) a(a), (VALUES (-1), (0), (1)) s(s), (VALUES (-1), (0), (1)) r(r)),
 o AS (SELECT *, 0.5 * (b1 * b1 * xx + 2 * b1 * b2 * xz + b2 * b2 * zz) - b1 * xy - b2 * zy + a * (abs(b1) + abs(b2)) AS cost FROM c WHERE sign(b1) = s AND sign(b2) = r),
 b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY series_id, a ORDER BY cost) = 1)
 SELECT d.series_id, d.date, b.a AS alpha, my + b1 * (d.temperature - mx) + b2 * (d.radiation_sum - mz) AS prediction FROM days d JOIN b USING (series_id) WHERE d.date >= DATE '2024-01-24'"""


@register("j16_lasso_per_series", "series_id date:d alpha:4 prediction:5", _lasso_sql())
def j16_lasso(spark, sf):
    _, train, test = _train_test(spark, sf)
    return closedform.linear_predict(test, closedform.lasso_fit(train, _TWO, "load_max", _LASSO_ALPHAS), _TWO)


@register("j16_lasso_without_penalty_per_series", "series_id date:d prediction:4", _ols_sql(0))
def j16_lasso_ols(spark, sf):
    _, train, test = _train_test(spark, sf)
    return closedform.linear_predict(test, closedform.lasso_fit(train, _TWO, "load_max", [1e-9]), _TWO)


def _pooled_sql(alpha: float) -> str:
    return f"""WITH t AS (SELECT temperature AS x, radiation_sum AS z, load_max AS y FROM days WHERE date < DATE '2024-01-24'),
 g AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) + {alpha} / count(*) AS xx, covar_pop(z, z) + {alpha} / count(*) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM t),
 b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM g)
 SELECT d.series_id, d.date, my + b1 * (d.temperature - mx) + b2 * (d.radiation_sum - mz) AS prediction FROM days d, b WHERE d.date >= DATE '2024-01-24'"""


def _pooled_two(spark, sf, params):
    _, train, test = _train_test(spark, sf)
    train = materialise(models.assemble(train.withColumn("label", F.col("load_max")), _TWO), "two")
    return models.fit_regressor("Linear Regression", params, train).transform(models.assemble(test, _TWO))


@register("j16_least_squares_pooled", "series_id date:d prediction:4", _pooled_sql(0))
def j16_pooled(spark, sf):
    return _pooled_two(spark, sf, {"reg_type": "none"})


@register("j16_ridge_two_features_pooled", "series_id date:d prediction:4", _pooled_sql(50.0))
def j16_ridge_two(spark, sf):
    return _pooled_two(spark, sf, {"reg_type": "ridge", "alpha": 50.0})


@register("j18_clipped_regression", "series_id date:d prediction:5",
          _ols_sql(0, "load_max - 150", "greatest(b0 + b1 * d.temperature + b2 * d.radiation_sum, 0)"))
def j18(spark, sf):
    _, train, test = _train_test(spark, sf)
    low = train.withColumn("y", F.col("load_max") - 150)
    return closedform.linear_predict(test, closedform.linear_fit(low, _TWO, "y"), _TWO, clip=True)


@register("j20_group_gram_regression", "series_id date:d prediction:6")
def j20(spark, sf):
    days = daily.day_features(panels.events_panel(spark, sf), trailing=True, fit=F.col("date") < F.lit(TEST_START).cast("date"))
    train = days.filter(F.col("date") < F.lit(TEST_START).cast("date"))
    test = days.filter(F.col("date") >= F.lit(TEST_START).cast("date"))
    return closedform.linear_predict(test, closedform.linear_fit(train, _ALL_FEATURES, "load_max", alpha=1.0), _ALL_FEATURES)


# A planted rule on the days of the panel: weekends, days of the second half of the month, other days. Its classes and levels
# follow from the calendar, so SQL knows what a learner that has understood the rule answers.
_RULE = "CASE WHEN isodow(date) >= 6 THEN 0 WHEN day(date) > 15 THEN 1 ELSE 2 END"
_LEVEL = "CASE WHEN isodow(date) >= 6 THEN 10 ELSE 0 END + CASE WHEN day(date) > 15 THEN 3 ELSE 0 END"
_PLANTED = ["weekday", "day"]


def planted(spark, sf, label):
    days = panels.events_panel(spark, sf).select("series_id", F.to_date("ts").alias("date")).distinct().withColumns(
        {"weekday": F.weekday("date") / 6.0, "day": F.day("date") / 30.0})
    weekend, late = F.weekday("date") >= 5, F.day("date") > 15
    value = {
        "rule": F.when(weekend, 0).when(late, 1).otherwise(2), "level": F.when(weekend, 10).otherwise(0) + F.when(late, 3).otherwise(0),
        "slope": F.weekday("date") * 2 - F.day("date") + 3,
    }[label]
    return materialise(models.assemble(days, _PLANTED).withColumn("label", value.cast("double")), "planted")


def _planted_classes(name, params):
    def run(spark, sf):
        m = planted(spark, sf, "rule")
        return models.fit_classifier(name, params, m, 3).transform(m)

    return run


def _planted_numbers(name, params, label):
    def run(spark, sf):
        m = planted(spark, sf, label)
        return models.fit_regressor(name, params, m).transform(m)

    return run


_DAYS = "(SELECT DISTINCT series_id, date FROM panel)"
_BOOST = {"n_estimators": 12, "iterations": 12, "learning_rate": 0.5, "max_depth": 3, "depth": 3, "min_child_samples": 1}
for _id, _name, _params in [
    ("j1_cart_planted", "CART", {"max_depth": 4}), ("j2_xgboost_planted", "XGBoost", _BOOST), ("j3_lightgbm_planted", "LightGBM", _BOOST),
    ("j4_catboost_planted", "CatBoost", _BOOST), ("j5_linear_svm_planted", "SVM Linear", {"C": 1000.0}), ("j6_kernel_svm_planted", "SVM Non-Linear", {"C": 1000.0, "gamma": "20"}),
    ("j8_logistic_planted", "Logistic Regression", {"C": 1e6, "max_iter": 1000}), ("j9_forest_planted", "Random Forest", {"max_depth": 6, "max_features": "all", "n_estimators": 20}),
]:
    register(_id, "series_id date:d prediction:i", f"SELECT series_id, date, {_RULE} AS prediction FROM {_DAYS}")(_planted_classes(_name, _params))
for _id, _name, _params, _label in [
    ("j10_cart_planted", "CART", {"max_depth": 4}, "level"), ("j11_xgboost_planted", "XGBoost", {**_BOOST, "n_estimators": 60}, "level"),
    ("j12_lightgbm_planted", "LightGBM", {**_BOOST, "n_estimators": 60}, "level"), ("j13_catboost_planted", "CatBoost", {**_BOOST, "iterations": 60}, "level"),
    ("j14_linear_svr_planted", "SVR Linear", {"C": 10000.0, "epsilon": 0.05}, "slope"), ("j15_kernel_svr_planted", "SVR Non-Linear", {"C": 10000.0, "epsilon": 0.05, "gamma": "20"}, "level"),
    ("j17_forest_planted", "Random Forest", {"max_depth": 6, "max_features": "all", "n_estimators": 20}, "level"),
]:
    _value = _LEVEL if _label == "level" else "2 * (isodow(date) - 1) - day(date) + 3"
    register(_id, "series_id date:d prediction:0", f"SELECT series_id, date, {_value} AS prediction FROM {_DAYS}")(_planted_numbers(_name, _params, _label))


@register("j19_class_probabilities", "series_id date:d likeliest:i sure:i total:6",
          f"SELECT series_id, date, {_RULE} AS likeliest, 1 AS sure, 1.0 AS total FROM {_DAYS}")
def j19(spark, sf):
    m = planted(spark, sf, "rule")
    out = models.fit_classifier("SVM Linear", {"C": 1000.0}, m, 3).transform(m)
    top = F.array_max("probs")
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    return out.select("series_id", "date", (F.array_position("probs", top) - 1).alias("likeliest"), (top > 0.5).cast("int").alias("sure"), total.alias("total"))


# ---- search and evaluation ---------------------------------------------------------------------------------------

_FAST = ["CART", "Naive Bayes", "Logistic Regression", "SVM Linear"]


@register("k1_classifier_search", "model best_score:6 n_trials:i")
def k1(spark, sf):
    m = matrix(spark, sf).drop("role")
    return search.search_classifiers(m, 3, n_trials=2, cv=2, exclude=[n for n in spaces.CLASSIFIER_SPACES if n not in _FAST])


@register("k1_regressor_search", "model best_score:6 n_trials:i")
def k1_reg(spark, sf):
    m = matrix(spark, sf, "load_max", True).drop("role")
    return search.search_regressors(m, n_trials=2, cv=2, exclude=["XGBoost", "LightGBM", "CatBoost", "SVR Non-Linear", "Random Forest"])


def _settings(spark, sf, names, space):
    """One setting per model, keyed off the models that the table of given names holds."""
    rows = [(n, 0.0, {k: str(v) for k, v in spaces.middle(space[n]).items()}, 1) for n in names]
    return spark.createDataFrame(rows, search.RESULT)


@register("k2_classifier_evaluation", "model accuracy:6 precision:6 recall:6 accuracy_std:6 roc_auc:6")
def k2(spark, sf):
    return search.evaluate_classifiers(matrix(spark, sf).drop("role"), _settings(spark, sf, _FAST, spaces.CLASSIFIER_SPACES), 3, 2)


@register("k2_regressor_evaluation", "model r2:6 mae:6 mse:6 rmse:6 mape:6 r2_std:6")
def k2_reg(spark, sf):
    return search.evaluate_regressors(matrix(spark, sf, "load_max", True).drop("role"), _settings(spark, sf, ["CART", "Linear Regression", "SVR Linear"], spaces.REGRESSOR_SPACES), 2)


@register("k3_stratified_folds", "series_id date:d fold:i",
          """WITH d AS (SELECT series_id, date, cluster, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS rn FROM labels_det),
                  f AS (SELECT *, min(rn) OVER (PARTITION BY series_id, cluster) AS first FROM d),
                  p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY first, rn) - 1 AS pos, row_number() OVER (PARTITION BY series_id, cluster ORDER BY rn) AS r FROM f),
                  a AS (SELECT series_id, cluster, pos % 3 AS fold, count(*) AS n FROM p GROUP BY ALL),
                  u AS (SELECT *, sum(n) OVER (PARTITION BY series_id, cluster ORDER BY fold) AS upto FROM a)
             SELECT p.series_id, p.date, min(u.fold) AS fold FROM p JOIN u ON u.series_id = p.series_id AND u.cluster = p.cluster AND p.r <= u.upto GROUP BY 1, 2""")
def k3(spark, sf):
    return folds.stratified_fold(day_labels(spark, sf), 3)


@register("k4_contiguous_folds", "series_id date:d fold:i",
          "SELECT series_id, date, ntile(7) OVER (PARTITION BY series_id ORDER BY date) - 1 AS fold FROM orders_days")
def k4(spark, sf):
    return folds.with_day_index(panels.orders_panel(spark, sf)).withColumn("fold", folds.contiguous_fold(7))


_BLOCKS = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS m FROM orders_days)
 SELECT series_id, k.k AS fold, role, count(*) AS days, min(date) AS first_date, max(date) AS last_date FROM (
   SELECT series_id, date, k.k, {role} AS role FROM d, (VALUES (1), (2), (3)) k(k)) k WHERE role IS NOT NULL GROUP BY 1, 2, 3"""


def _fold_summary(df):
    return df.groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@register("k5_expanding_folds", "series_id fold:i role days:i first_date:d last_date:d",
          _BLOCKS.format(role="CASE WHEN i < m - (4 - k.k) * (m // 4) THEN 'train' WHEN i < m - (3 - k.k) * (m // 4) THEN 'test' END"))
def k5(spark, sf):
    return _fold_summary(folds.expanding_roles(folds.with_day_index(panels.orders_panel(spark, sf)), 3))


@register("k5_expanding_row_folds", "series_id ts:t fold:i role",
          """SELECT series_id, ts, fold, role FROM (SELECT series_id, ts, k.k AS fold, CASE WHEN rn < series_rows - (3 - k.k) * (series_rows // 3) THEN 'train'
             WHEN rn < series_rows - (2 - k.k) * (series_rows // 3) THEN 'test' END AS role FROM panel, (VALUES (1), (2)) k(k)) WHERE role IS NOT NULL""")
def k5_rows(spark, sf):
    return folds.expanding_roles(panel(spark, sf), 2)


@register("k6_complement_folds", "series_id fold:i role days:i first_date:d last_date:d",
          _BLOCKS.format(role="CASE WHEN i >= m - (4 - k.k) * (m // 4) AND i < m - (3 - k.k) * (m // 4) THEN 'test' ELSE 'train' END"))
def k6(spark, sf):
    return _fold_summary(folds.complement_roles(folds.with_day_index(panels.orders_panel(spark, sf)), 3))


@register("k7_classification_scores", "series_id accuracy:6 precision:6 recall:6",
          """WITH c AS (SELECT DISTINCT series_id, c FROM (SELECT series_id, cluster AS c FROM labels_det UNION ALL SELECT series_id, cluster2 FROM labels_det)),
                  s AS (SELECT c.series_id, c.c, sum(CASE WHEN l.cluster = c.c AND l.cluster2 = c.c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN l.cluster2 = c.c THEN 1 ELSE 0 END) AS pp,
                        sum(CASE WHEN l.cluster = c.c THEN 1 ELSE 0 END) AS ap FROM c JOIN labels_det l USING (series_id) GROUP BY 1, 2)
             SELECT series_id, sum(tp) / sum(ap) AS accuracy, avg(coalesce(tp / nullif(pp, 0), 0)) AS precision, avg(coalesce(tp / nullif(ap, 0), 0)) AS recall FROM s GROUP BY 1""")
def k7(spark, sf):
    return metrics.classification_scores(day_labels(spark, sf), ["series_id"], "cluster", "cluster2")


@register("k8_one_vs_one_auc", "series_id roc_auc:6",
          """WITH d AS (SELECT s.series_id, a.a AS pos, b.b AS neg, s.label, CASE a.a WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p
                        FROM scores_det s, (VALUES (0), (1), (2)) a(a), (VALUES (0), (1), (2)) b(b) WHERE a.a <> b.b AND s.label IN (a.a, b.b)),
                  r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY series_id, pos, neg, p) - 1) / 2.0 AS r FROM d WINDOW w AS (PARTITION BY series_id, pos, neg ORDER BY p)),
                  u AS (SELECT series_id, pos, neg, count(*) FILTER (WHERE label = pos) AS np, count(*) FILTER (WHERE label = neg) AS nn, sum(r) FILTER (WHERE label = pos) AS sr FROM r GROUP BY 1, 2, 3)
             SELECT series_id, avg((sr - np * (np + 1) / 2.0) / (np * nn)) AS roc_auc FROM u GROUP BY 1""")
def k8(spark, sf):
    p = panels.events_panel(spark, sf)
    raw = [F.lit(1) + F.col("temperature") % 7, F.lit(1) + F.col("temperature") % 5, F.lit(1) + F.col("radiation") % 3]
    z = raw[0] + raw[1] + raw[2]
    scores = p.withColumn("date", F.to_date("ts")).join(day_labels(spark, sf), ["series_id", "date"]).select(
        "series_id", F.col("cluster").alias("label"), F.array(*[r / z for r in raw]).alias("probs"))
    return metrics.auc_one_vs_one(scores, ["series_id"])


_FOLD_PAIRS = """WITH f AS (SELECT series_id, rn % 3 AS fold, total AS a, last_day AS p FROM holdout WHERE last_day IS NOT NULL),
  s AS (SELECT series_id, fold, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2, avg(abs(a - p)) AS mae, avg((a - p) * (a - p)) AS mse,
        avg(abs(a - p) / greatest(abs(a), 2.220446049250313e-16)) * 100 AS mape FROM f GROUP BY 1, 2)"""


@register("k9_fold_regression_scores", "series_id r2:6 mae:6 mse:6 rmse:6 mape:4 r2_std:6",
          _FOLD_PAIRS + " SELECT series_id, avg(r2) AS r2, avg(mae) AS mae, avg(mse) AS mse, sqrt(avg(mse)) AS rmse, avg(mape) AS mape, stddev_pop(r2) AS r2_std FROM s GROUP BY 1")
def k9(spark, sf):
    p = pairs(spark, sf).withColumn("fold", F.col("rn") % 3).dropna(subset=["predicted"])
    return metrics.regression_leaderboard(metrics.fold_regression_scores(p, ["series_id", "fold"]), ["series_id"])


@register("k10_hybrid_measures", "series_id r2:6 mae:6 mse:6 rmse:6 wmape_signed:6",
          """SELECT series_id, 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - predicted)) AS mae,
                    avg((actual - predicted) * (actual - predicted)) AS mse, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
                    sum(abs(actual - predicted)) / sum(actual) * 100 AS wmape_signed FROM hard_pairs GROUP BY 1""")
def k10(spark, sf):
    return metrics.hybrid_metrics(hard_pairs(spark, sf), ["series_id"])


_BENCH = """SELECT series_id, model, 1 - sum((total - p) * (total - p)) / (var_pop(CASE WHEN p IS NOT NULL THEN total END) * count(p)) AS r2, avg(abs(total - p)) AS mae,
   sqrt(avg((total - p) * (total - p))) AS rmse, avg(CASE WHEN abs(total) > 1e-10 THEN abs((total - p) / total) END) * 100 AS mape,
   sum(abs(total - p)) / sum(CASE WHEN p IS NOT NULL THEN abs(total) END) * 100 AS wmape, count(p) AS valid_samples, count(*) AS total_samples
   FROM {src} GROUP BY 1, 2 HAVING count(p) > 0"""
_BENCH_OUT = "series_id model r2:6 mae:6 rmse:6 mape:4 wmape:6 valid_samples:i total_samples:i"


@register("k11_benchmark_measures", _BENCH_OUT, _BENCH.format(src="(SELECT series_id, 'All rows' AS model, total, last_day AS p FROM lagged)"))
def k11(spark, sf):
    from meterloom.catalog.tables import lagged

    return metrics.benchmark_metrics(lagged(spark, sf).withColumn("model", F.lit("All rows")), ["series_id", "model"], "total", "last_day")


_DIAG = """SELECT series_id, avg(abs(a - p)) AS mae, avg((a - p) * (a - p)) AS mse, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2,
   avg(CASE WHEN abs(a) > 1e-10 THEN abs((a - p) / a) END) * 100 AS mape, sqrt(avg((a - p) * (a - p))) / avg(a) * 100 AS cv_rmse, avg(a - p) AS mean_residual,
   stddev_pop(a - p) AS std_residual, max(abs(a - p)) AS max_error, avg(a) AS actual_mean, stddev_pop(a) AS actual_std, avg(p) AS predicted_mean, stddev_pop(p) AS predicted_std
   FROM {src} GROUP BY 1"""
_DIAG_OUT = "series_id mae:6 mse:6 rmse:6 r2:6 mape:4 cv_rmse:6 mean_residual:6 std_residual:6 max_error:6 actual_mean:6 actual_std:6 predicted_mean:6 predicted_std:6"
_HELD = "(SELECT series_id, total AS a, last_day AS p FROM holdout WHERE last_day IS NOT NULL)"


@register("k12_full_diagnostics", _DIAG_OUT, _DIAG.format(src=_HELD))
def k12(spark, sf):
    return metrics.full_diagnostics(pairs(spark, sf), ["series_id"])


@register("k13_residuals", "series_id ts:t residual:6", "SELECT series_id, ts, total - last_day AS residual FROM holdout WHERE last_day IS NOT NULL")
def k13(spark, sf):
    return pairs(spark, sf).withColumn("residual", F.col("actual") - F.col("predicted")).dropna(subset=["residual"])


@register("k14_forecast_evaluation", _DIAG_OUT, _DIAG.format(src="(SELECT series_id, actual AS a, predicted AS p FROM hard_pairs)"))
def k14(spark, sf):
    from meterloom.catalog.forecasts import hard_forecast

    return evaluation.evaluate_forecast(panel(spark, sf), hard_forecast(spark, sf))


@register("k15_failed_models", "series_id model valid_samples:i",
          """SELECT s.series_id, m.m AS model, coalesce(b.valid_samples, 0) AS valid_samples FROM (SELECT DISTINCT series_id FROM load15) s
             CROSS JOIN (VALUES ('Last Day'), ('Last Week'), ('Zero Shot')) m(m) LEFT JOIN (SELECT series_id, 'Last Day' AS model, count(last_day) AS valid_samples FROM holdout GROUP BY 1
             UNION ALL SELECT series_id, 'Last Week', count(last_week) FROM holdout GROUP BY 1) b ON b.series_id = s.series_id AND b.model = m.m""")
def k15(spark, sf):
    from meterloom.plans.persistence import persistence_backtest

    p = panels.events_panel(spark, sf)
    names = F.array(*[F.lit(n) for n in ("Last Day", "Last Week", "Zero Shot")])
    expected = p.select("series_id").distinct().withColumn("model", F.explode(names))
    return metrics.with_missing_models(persistence_backtest(p, TEST_START), expected, ["series_id", "model"])


@register("k16_best_model_summary", "series_id variant model wmape:6",
          """WITH v AS (SELECT series_id, variant, ts, value, lag(value, 96) OVER w AS d, lag(value, 672) OVER w AS k FROM variants WINDOW w AS (PARTITION BY series_id, variant ORDER BY ts)),
                  b AS (SELECT series_id, variant, 'Last Day' AS model, sum(abs(value - d)) / sum(abs(value)) * 100 AS wmape FROM v WHERE ts >= TIMESTAMP '2024-01-24' AND d IS NOT NULL GROUP BY 1, 2
                        UNION ALL SELECT series_id, variant, 'Last Week', sum(abs(value - k)) / sum(abs(value)) * 100 FROM v WHERE ts >= TIMESTAMP '2024-01-24' AND k IS NOT NULL GROUP BY 1, 2)
             SELECT series_id, variant, model, wmape FROM b QUALIFY row_number() OVER (PARTITION BY series_id, variant ORDER BY wmape, model) = 1""")
def k16(spark, sf):
    from meterloom.plans.persistence import persistence_backtest

    p = panel(spark, sf)
    boards = persistence_backtest(p, TEST_START, "total").withColumn("variant", F.lit("raw")).unionByName(
        persistence_backtest(p, TEST_START, "total_filter").withColumn("variant", F.lit("filter")))
    return ranking.best_per_setting(boards, "wmape", ["series_id", "variant"])


@register("k26_last_day", _BENCH_OUT, _BENCH.format(src="(SELECT series_id, 'Last Day' AS model, total, last_day AS p FROM holdout)"))
def k26(spark, sf):
    from meterloom.plans.persistence import persistence_backtest

    return persistence_backtest(panels.events_panel(spark, sf), TEST_START).filter("model = 'Last Day'")


@register("k27_last_week", _BENCH_OUT, _BENCH.format(src="(SELECT series_id, 'Last Week' AS model, total, last_week AS p FROM holdout)"))
def k27(spark, sf):
    from meterloom.plans.persistence import persistence_backtest

    return persistence_backtest(panels.events_panel(spark, sf), TEST_START).filter("model = 'Last Week'")
