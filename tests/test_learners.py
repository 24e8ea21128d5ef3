import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from meterloom.learners import closedform, models, search, spaces
from meterloom.operators import metrics, ranking
from meterloom.session import materialise


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 4))
    y = x @ np.array([1.5, -2.0, 0.0, 0.7]) + 3 + rng.normal(0, 0.3, 120)
    lab = np.digitize(x[:, 0] + 0.3 * rng.normal(size=120), [-0.4, 0.6])
    return x, y, lab


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y, lab = numbers
    rows = [("a" if i % 2 else "b", i, [float(v) for v in x[i]], float(y[i]), int(lab[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "series_id string, i int, vec array<double>, y double, c int")
    df = df.withColumns({f"x{j}": F.col("vec")[j] for j in range(4)}).withColumn("date", F.date_add(F.lit("2021-01-01").cast("date"), F.col("i")))
    return materialise(df.withColumn("features", array_to_vector("vec")).withColumn("label", F.col("y")), "numbers")


XS = [f"x{j}" for j in range(4)]


def ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("alpha", [0.0, 5.0])
def test_group_regression_equals_numpy_per_series(table, numbers, alpha):
    x, y, _ = numbers
    for r in closedform.linear_fit(table, XS, "y", alpha=alpha).collect():
        own = np.arange(120) % 2 == (r["series_id"] == "a")
        w, b = ridge(x[own], y[own], alpha)
        np.testing.assert_allclose(r["coef"], w, atol=1e-9)
        assert abs(r["intercept"] - b) < 1e-9 and r["n"] == 60


def test_distributed_ridge_and_lasso_penalties(table, numbers):
    x, y, _ = numbers
    fitted = models.fit_regressor("Linear Regression", {"reg_type": "ridge", "alpha": "7.5"}, table).stages[0]
    w, b = ridge(x, y, 7.5)
    np.testing.assert_allclose(fitted.coefficients.toArray(), w, atol=1e-5)
    assert abs(fitted.intercept - b) < 1e-5
    lasso = models.fit_regressor("Linear Regression", {"reg_type": "lasso", "alpha": "0.2"}, table).stages[0]
    w = lasso.coefficients.toArray()
    grad = x.T @ (y - x @ w - lasso.intercept) / len(y)
    active = np.abs(w) > 1e-6
    np.testing.assert_allclose(grad[active], 0.2 * np.sign(w[active]), atol=1e-4)
    assert (np.abs(grad[~active]) <= 0.2 + 1e-4).all()


def test_logistic_penalty_matches_its_stationarity_condition(table, numbers):
    x, _, lab = numbers
    two = table.withColumn("label", (F.col("c") > 0).cast("double"))
    model = models.fit_classifier("Logistic Regression", {"C": 2.0, "max_iter": 500}, two, 2).stages[0]
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    np.testing.assert_allclose(2.0 * x.T @ ((lab > 0) - p), w, atol=0.05)


@pytest.mark.parametrize("name", ["CART", "SVM Linear", "SVM Non-Linear", "Naive Bayes", "Random Forest"])
def test_classifiers_learn_and_give_probabilities(table, name):
    data = table.withColumn("label", F.col("c").cast("double"))
    params = {**spaces.middle(spaces.CLASSIFIER_SPACES[name]), "C": 5.0, "max_depth": 4}
    out = models.fit_classifier(name, params, data, 3).transform(data).select("label", "prediction", "probs").toPandas()
    assert (out["label"] == out["prediction"]).mean() > 0.75
    probs = np.stack(out["probs"])
    assert probs.shape == (120, 3) and (probs >= 0).all()
    np.testing.assert_allclose(probs.sum(1), 1, atol=1e-9)


@pytest.mark.parametrize("name", ["CART", "SVR Linear", "SVR Non-Linear", "Random Forest"])
def test_regressors_beat_the_mean(table, numbers, name):
    params = {**spaces.middle(spaces.REGRESSOR_SPACES[name]), "C": 100.0, "max_depth": 6, "max_features": "all"}
    out = models.fit_regressor(name, params, table).transform(table).select("label", "prediction").toPandas()
    sst = ((out["label"] - out["label"].mean()) ** 2).sum()
    assert 1 - ((out["label"] - out["prediction"]) ** 2).sum() / sst > 0.5


def test_boosting_two_and_three_classes(table):
    params = {"n_estimators": 5, "max_depth": 2}
    for classes, label in ((2, (F.col("c") > 0).cast("double")), (3, F.col("c").cast("double"))):
        data = table.withColumn("label", label)
        out = models.fit_classifier("XGBoost", params, data, classes).transform(data)
        assert out.filter("label = prediction").count() > 90
        assert out.select(F.size("probs").alias("s")).distinct().first()["s"] == classes
    assert models.fit_regressor("CatBoost", {"iterations": 5, "depth": 2, "border_count": 32}, table).transform(table).count() == 120


def test_fourier_features_approach_the_gaussian_kernel(table, numbers):
    x = numbers[0][:40]
    rows = models.fourier_map(4, 0.3, 2048)(table.filter("i < 40")).orderBy("i").select(vector_to_array("mapped").alias("m")).toPandas()
    z = np.stack(rows["m"])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.12


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 400
    lab = rng.integers(0, 3, n)
    p = np.round(rng.dirichlet([1, 1, 1], n), 2)
    df = spark.createDataFrame([("a", int(lab[i]), [float(v) for v in p[i]]) for i in range(n)], "series_id string, label int, probs array<double>")
    total = []
    for a in range(3):
        for b in range(3):
            if a != b:
                pos, neg = p[lab == a, a], p[lab == b, a]
                total.append(((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean())
    for pieces in (2, 7, 200):
        got = metrics.auc_one_vs_one(df, ["series_id"], pieces=pieces).first()["roc_auc"]
        assert abs(got - np.mean(total)) < 1e-12


def test_search_draws_are_seeded_and_failures_skip_the_model(table):
    data = table.withColumn("label", F.col("c").cast("double")).select("series_id", "date", "features", "label")
    space = {"CART": ["max_depth int 2 4"], "Naive Bayes": ["var_smoothing log 1e-10 1e-5"], "Unknown": ["x int 1 2"]}
    a = search.search_classifiers(data, 3, 2, 2, space=space).collect()
    b = search.search_classifiers(data, 3, 2, 2, space=space).collect()
    assert a == b and {r["model"] for r in a} == {"CART", "Naive Bayes"}
    board = search.evaluate_classifiers(data, data.sparkSession.createDataFrame(a, search.RESULT), 3, 2).collect()
    assert [r["accuracy"] for r in board] == sorted((r["accuracy"] for r in board), reverse=True)
    assert search.search_classifiers(data, 3, 1, 2, exclude=["CART", "Unknown"], space=space).count() == 1


def test_search_spaces_hold_every_draw(spark):
    import random

    space = {**spaces.CLASSIFIER_SPACES}
    rows = {(r["model"], r["param"]): r for r in spaces.space_table(spark, space).collect()}
    for model, lines in space.items():
        for seed in range(20):
            for name, value in spaces.draw(lines, random.Random(seed)).items():
                r = rows[model, name]
                assert value in r["choices"] if r["kind"] == "choice" else r["low"] <= value <= r["high"]


def test_leaderboard_puts_missing_last_and_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 0.5)], "model string, rmse double")
    order = [r["model"] for r in ranking.leaderboard(df, "rmse").orderBy("place").collect()]
    assert order == ["d", "a", "b", "c"]


def test_null_label_is_an_error(spark):
    from meterloom.functions.encode import strict_label

    df = spark.createDataFrame([(1.0,), (None,)], "c double")
    with pytest.raises(Exception, match="null class label"):
        df.select(strict_label("c")).collect()
