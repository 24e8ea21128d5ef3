"""Classifier and regressor builders by name, on a shared feature matrix.

Input tables hold a vector column ``features`` and, for training, ``label``. A fitted classifier adds ``prediction`` and
``probs``; a fitted regressor adds ``prediction``. The fits are distributed over the rows of all series, so their number
depends on the settings and never on the data. Features arrive scaled, hence ``standardization=False`` throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from meterloom.learners import boosting, closedform, kernels, tube
from meterloom.session import run_parallel

SEED = 42
# Stopping tolerances of the margin and logistic fits.
SVM_TOLERANCE = 1e-3
LOGISTIC_TOLERANCE = 1e-4


@dataclass
class Fitted:
    """A fitted learner: ``transform`` adds its outputs to a table with ``features``."""

    name: str
    transform: Callable[[DataFrame], DataFrame]
    stages: tuple = ()


def assemble(df: DataFrame, columns, target: str = "features") -> DataFrame:
    """Feature vector from numeric columns. Rows with a missing feature cannot be learned from and are dropped;
    :func:`incomplete_rows` counts them."""
    return df.dropna(subset=list(columns)).withColumn(target, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def incomplete_rows(df: DataFrame, columns, keys=("series_id",)) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.groupBy(*keys).agg(F.count_if(missing).alias("dropped"), F.count(F.lit(1)).alias("rows"))


def _depth(params: Mapping, name: str = "max_depth", default: int = 5) -> int:
    return int(params.get(name, default))


def _subset(params: Mapping) -> str:
    choice = str(params.get("max_features", "sqrt"))
    return {"None": "all"}.get(choice, choice)


def fourier_map(width: int, gamma: float, size: int = kernels.SIZE, seed: int = SEED) -> Callable[[DataFrame], DataFrame]:
    """Random Fourier features of the Gaussian kernel as a step on tables."""
    return kernels.mapped(kernels.fourier_map(width, gamma, size, seed))


# ---- classifiers -------------------------------------------------------------------------------------------------


def _by_binary_fits(
    build: Callable[[], object], prepare: Callable[[DataFrame], DataFrame], train: DataFrame, n_classes: int, pairwise: bool
) -> tuple[Callable[[DataFrame], DataFrame], tuple]:
    """Several classes from binary fits that run side by side, and probabilities by a logistic fit on their margins.

    ``pairwise`` fits every pair of classes and lets them vote; otherwise each class is fitted against the rest and the
    largest margin wins. Scoring stays in column expressions, so no Python touches the rows.
    """
    ready = prepare(train)
    present = sorted(int(r["label"]) for r in train.select("label").distinct().toLocalIterator())
    if len(present) < 2:
        raise ValueError("a classifier needs at least two classes")
    if pairwise or len(present) == 2:
        duels = [(b, a) for i, a in enumerate(present) for b in present[i + 1 :]]
    else:
        duels = [(c, None) for c in present]

    def fit(first: int, second: int | None):
        rows = ready if second is None else ready.filter(F.col("label").isin(first, second))
        return build().fit(rows.withColumn("label", (F.col("label") == first).cast("double")))

    fitted = run_parallel([(lambda d=d: fit(*d)) for d in duels])
    names = [f"_m{i}" for i in range(len(duels))]

    def margins(df: DataFrame) -> DataFrame:
        out = prepare(df)
        keep = out.columns
        for i, m in enumerate(fitted):
            out = m.transform(out).withColumn(names[i], vector_to_array("rawPrediction")[1]).select(*keep, *names[: i + 1])
        if duels[0][1] is None:
            support = {c: F.col(n) for n, (c, _) in zip(names, duels)}
        else:
            support = {c: F.lit(0) for c in present}
            for n, (first, second) in zip(names, duels):
                won = F.col(n) > 0
                support[first] = support[first] + won.cast("int")
                support[second] = support[second] + (~won).cast("int")
        best = F.array_max(F.array(*[F.struct(v.cast("double").alias("v"), F.lit(-c).alias("c")) for c, v in support.items()]))
        cells = F.array(*[F.col(n) for n in names])
        return out.withColumn("prediction", (-best["c"]).cast("int")).withColumn("_margins", array_to_vector(cells)).drop(*names)

    link = LogisticRegression(
        featuresCol="_margins", probabilityCol="_prob", predictionCol="_p", rawPredictionCol="_r", regParam=1e-4, standardization=False, maxIter=50, tol=LOGISTIC_TOLERANCE,
    ).fit(margins(train).select("label", "_margins"))

    def apply(df: DataFrame) -> DataFrame:
        out = link.transform(margins(df))
        return out.withColumn("probs", _padded(vector_to_array("_prob"), n_classes)).drop("_prob", "_p", "_r", "_margins", "mapped")

    return apply, (*fitted, link)


def _padded(probs: Column, n_classes: int) -> Column:
    """Zeros for classes that the training rows did not contain."""
    return F.slice(F.concat(probs, F.array_repeat(F.lit(0.0), n_classes)), 1, n_classes)


def _native(model, n_classes: int) -> Callable[[DataFrame], DataFrame]:
    def apply(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        out = out.withColumn("probs", _padded(vector_to_array("probability"), n_classes)).withColumn("prediction", F.col("prediction").cast("int"))
        return out.drop("rawPrediction", "probability")

    return apply


def _boosted_classes(name: str, params: Mapping, train: DataFrame, n_classes: int) -> Callable[[DataFrame], DataFrame]:
    model = boosting.fit(train, boosting.options(name, params), n_classes)

    def apply(df: DataFrame) -> DataFrame:
        out = df.withColumn("_m", model.margin_column())
        if n_classes == 2:
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")[0]))
            probs = F.array(F.lit(1.0) - p, p)
        else:
            top = F.array_max("_m")
            weights = F.transform("_m", lambda m: F.exp(m - top))
            probs = F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v))
        best = F.array_max(F.transform("probs", lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
        return out.withColumn("probs", probs).withColumn("prediction", (-best["i"]).cast("int")).drop("_m")

    return apply


def fit_classifier(name: str, params: Mapping, train: DataFrame, n_classes: int) -> Fitted:
    """Fit the named classifier on ``features`` and ``label`` (0 .. n_classes-1)."""
    if name == "Naive Bayes":
        width = len(train.select("features").first()["features"])
        cols = [f"x{i}" for i in range(width)]
        every = ("_all",)
        spread = lambda df: df.withColumn("_a", vector_to_array("features")).withColumns({c: F.col("_a")[i] for i, c in enumerate(cols)}).drop("_a").withColumn("_all", F.lit(0))
        model = closedform.bayes_fit(spread(train), cols, "label", every, float(params.get("var_smoothing", 1e-9)))
        return Fitted(name, lambda df: closedform.bayes_predict(spread(df), model, cols, n_classes, every).drop("_all", *cols))
    if name == "CART":
        est = DecisionTreeClassifier(
            maxDepth=_depth(params), minInstancesPerNode=int(params.get("min_samples_leaf", 1)), impurity=str(params.get("criterion", "gini")), seed=SEED
        )
    elif name == "Random Forest":
        est = RandomForestClassifier(
            numTrees=int(params.get("n_estimators", 100)), maxDepth=_depth(params), minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params), seed=SEED,
        )
    elif name == "Logistic Regression":
        n = train.count()
        est = LogisticRegression(regParam=1.0 / (n * float(params.get("C", 1.0))), elasticNetParam=0.0, maxIter=int(params.get("max_iter", 100)), standardization=False, tol=LOGISTIC_TOLERANCE)
    elif name in ("XGBoost", "LightGBM", "CatBoost"):
        return Fitted(name, _boosted_classes(name, params, train, n_classes))
    elif name in ("SVM Linear", "SVM Non-Linear"):
        n = train.count()
        prepare = kernels.fit_map(params, train)[0] if name == "SVM Non-Linear" else (lambda d: d)
        col = "mapped" if name == "SVM Non-Linear" else "features"
        penalty = 1.0 / (n * float(params.get("C", 1.0)))
        build = lambda: LinearSVC(featuresCol=col, regParam=penalty, standardization=False, maxIter=100, tol=SVM_TOLERANCE)
        return Fitted(name, *_by_binary_fits(build, prepare, train, n_classes, pairwise=True))
    else:
        raise ValueError(f"unknown classifier {name!r}")
    model = est.fit(train)
    return Fitted(name, _native(model, n_classes), (model,))


# ---- regressors --------------------------------------------------------------------------------------------------


def _linear(params: Mapping, train: DataFrame) -> LinearRegression:
    """Ordinary, ridge or lasso regression with the penalty on the scale of summed squared errors (ridge) or of half the
    mean squared error (lasso). The solver scales its ridge penalty by the label deviation, which is undone here."""
    kind, alpha = params.get("reg_type", "none"), float(params.get("alpha", 1.0))
    if kind == "ridge":
        stats = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("sd")).first()
        return LinearRegression(regParam=alpha * (stats["sd"] or 1.0) / stats["n"], elasticNetParam=0.0, solver="normal", standardization=False)
    if kind == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, solver="l-bfgs", standardization=False, maxIter=1000, tol=1e-9)
    return LinearRegression(solver="normal", standardization=False)


def fit_regressor(name: str, params: Mapping, train: DataFrame) -> Fitted:
    """Fit the named regressor on ``features`` and ``label``."""
    prepare: Callable[[DataFrame], DataFrame] = lambda d: d
    if name == "CART":
        est = DecisionTreeRegressor(maxDepth=_depth(params), minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=SEED)
    elif name == "Random Forest":
        est = RandomForestRegressor(
            numTrees=int(params.get("n_estimators", 100)), maxDepth=_depth(params), minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            featureSubsetStrategy=_subset(params), seed=SEED,
        )
    elif name in ("XGBoost", "LightGBM", "CatBoost"):
        trees = boosting.fit(train, boosting.options(name, params))
        return Fitted(name, lambda df: df.withColumn("prediction", trees.margin_column()[0]), (trees,))
    elif name == "Linear Regression":
        est = _linear(params, train)
    elif name in ("SVR Linear", "SVR Non-Linear"):
        if name == "SVR Non-Linear":
            prepare = kernels.fit_map(params, train)[0]
        col = "mapped" if name == "SVR Non-Linear" else "features"
        flat = tube.fit(prepare(train), float(params.get("C", 1.0)), float(params.get("epsilon", 0.1)), col)
        return Fitted(name, lambda df: prepare(df).withColumn("prediction", flat.column(col)).drop("mapped"), (flat,))
    else:
        raise ValueError(f"unknown regressor {name!r}")
    model = est.fit(prepare(train))
    return Fitted(name, lambda df: model.transform(prepare(df)).drop("mapped"), (model,))
