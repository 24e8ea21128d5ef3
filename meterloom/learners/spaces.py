"""Search spaces of the learners and seeded random draws from them."""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

# Parameter ranges as (name, kind, low, high) or (name, "choice", options).
CLASSIFIER_SPACES = {
    "CART": [("max_depth", "int", 2, 20), ("min_samples_split", "int", 2, 20), ("min_samples_leaf", "int", 1, 10), ("criterion", "choice", ["gini", "entropy"])],
    "XGBoost": [
        ("n_estimators", "int", 50, 300), ("learning_rate", "float", 0.01, 0.3), ("max_depth", "int", 2, 10), ("min_child_weight", "int", 1, 10),
        ("subsample", "float", 0.6, 1.0), ("colsample_bytree", "float", 0.6, 1.0), ("gamma", "float", 0.0, 5.0),
    ],
    "LightGBM": [
        ("n_estimators", "int", 50, 300), ("learning_rate", "float", 0.01, 0.3), ("max_depth", "int", 2, 10), ("num_leaves", "int", 20, 150),
        ("min_child_samples", "int", 5, 100), ("subsample", "float", 0.6, 1.0), ("colsample_bytree", "float", 0.6, 1.0),
        ("reg_alpha", "float", 0.0, 1.0), ("reg_lambda", "float", 0.0, 1.0),
    ],
    "CatBoost": [
        ("iterations", "int", 50, 300), ("learning_rate", "float", 0.01, 0.3), ("depth", "int", 2, 10), ("l2_leaf_reg", "float", 1.0, 10.0),
        ("border_count", "int", 32, 255),
    ],
    "SVM Linear": [("C", "log", 0.001, 100.0)],
    "SVM Non-Linear": [("kernel", "choice", ["rbf", "poly", "sigmoid"]), ("C", "log", 0.001, 100.0), ("gamma", "choice", ["scale", "auto"]), ("degree", "int", 2, 5)],
    "Naive Bayes": [("var_smoothing", "log", 1e-10, 1e-5)],
    "Logistic Regression": [("C", "log", 0.001, 100.0), ("max_iter", "int", 100, 1000)],
    "Random Forest": [
        ("n_estimators", "int", 50, 300), ("max_depth", "int", 2, 20), ("min_samples_split", "int", 2, 20), ("min_samples_leaf", "int", 1, 10),
        ("max_features", "choice", ["sqrt", "log2", "all"]),
    ],
}
REGRESSOR_SPACES = {
    "CART": [("max_depth", "int", 2, 20), ("min_samples_split", "int", 2, 20), ("min_samples_leaf", "int", 1, 10)],
    "XGBoost": CLASSIFIER_SPACES["XGBoost"],
    "LightGBM": CLASSIFIER_SPACES["LightGBM"],
    "CatBoost": CLASSIFIER_SPACES["CatBoost"],
    "SVR Linear": [("C", "log", 0.001, 100.0), ("epsilon", "float", 0.01, 1.0)],
    "SVR Non-Linear": [("kernel", "choice", ["rbf", "poly", "sigmoid"]), ("C", "log", 0.001, 100.0), ("epsilon", "float", 0.01, 1.0), ("gamma", "choice", ["scale", "auto"]), ("degree", "int", 2, 5)],
    "Linear Regression": [("reg_type", "choice", ["none", "ridge", "lasso"]), ("alpha", "log", 0.001, 100.0)],
    "Random Forest": CLASSIFIER_SPACES["Random Forest"],
}


def space_table(spark: SparkSession, spaces: Mapping[str, Iterable[tuple]]) -> DataFrame:
    """Search spaces as rows: model, param, kind, low, high, choices."""
    rows = []
    for model, params in spaces.items():
        for name, kind, *rest in params:
            numeric = kind != "choice"
            rows.append((model, name, kind, float(rest[0]) if numeric else None, float(rest[1]) if numeric else None, None if numeric else rest[0]))
    return spark.createDataFrame(rows, "model string, param string, kind string, low double, high double, choices array<string>")


def draw(params: Iterable[tuple], rng: random.Random) -> dict:
    """One random setting: uniform integers and floats, log-uniform floats, equally likely choices."""
    out: dict = {}
    for name, kind, *rest in params:
        if kind == "int":
            out[name] = rng.randint(*rest)
        elif kind == "float":
            out[name] = rng.uniform(*rest)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(rest[0]), math.log(rest[1])))
        else:
            out[name] = rng.choice(rest[0])
    return out


def middle(params: Iterable[tuple]) -> dict:
    """The low end of counts and depths, the centre of the other ranges, the first choice."""
    out: dict = {}
    for name, kind, *rest in params:
        if kind == "int":
            out[name] = rest[0]
        elif kind == "float":
            out[name] = (rest[0] + rest[1]) / 2
        elif kind == "log":
            out[name] = math.sqrt(rest[0] * rest[1])
        else:
            out[name] = rest[0][0]
    return out
