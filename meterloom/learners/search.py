"""Parameter search and re-evaluation of classifiers and regressors."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from meterloom.learners import models, spaces
from meterloom.operators import folds, metrics
from meterloom.operators.ranking import measure_order
from meterloom.session import run_parallel

RESULT = "model string, best_score double, best_params map<string,string>, n_trials int"


def _as_text(params: Mapping) -> dict[str, str]:
    return {k: str(v) for k, v in params.items()}


def cross_predict(fit: Callable[[DataFrame], models.Fitted], folded: DataFrame, splits: int) -> DataFrame:
    """Held-out predictions of every fold; ``folded`` has ``fold`` 1..splits and ``role``."""
    out = None
    for f in range(1, splits + 1):
        part = folded.filter(F.col("fold") == f)
        model = fit(part.filter("role = 'train'"))
        scored = model.transform(part.filter("role = 'test'"))
        out = scored if out is None else out.unionByName(scored)
    return out


def _search(names, n_trials, space, seed, score) -> list[tuple]:
    """Best of ``n_trials`` random settings per model with the number of trials that could be fitted; a model is left out when
    none could."""

    def trial(name: str, number: int):
        rng = random.Random(zlib.crc32(f"{seed}/{name}/{number}".encode()))
        params = spaces.draw(space[name], rng)
        try:
            value = score(name, params)
        except (ValueError, PySparkException):  # parameters that a learner refuses are a failed trial, not a failed search
            value = None
        return name, params, value

    done = run_parallel([(lambda n=n, t=t: trial(n, t)) for n in names for t in range(n_trials)])
    best: dict[str, tuple] = {}
    fitted = Counter(name for name, _, value in done if value is not None)
    for name, params, value in done:
        if value is not None and (name not in best or value > best[name][1]):
            best[name] = (params, value)
    return [(n, float(v), _as_text(p), fitted[n]) for n, (p, v) in best.items()]


def search_classifiers(
    data: DataFrame, n_classes: int, n_trials: int = 50, cv: int = 3, exclude: Iterable[str] = (), seed: int = 42,
    space: Mapping[str, list[tuple]] = spaces.CLASSIFIER_SPACES,
) -> DataFrame:
    """Maximise mean fold accuracy over an unshuffled stratified split.

    ``data``: series_id, date, features, label. It is read by every fit, so hand in a stored table.
    """
    indexed = folds.stratified_fold(data, cv, "label")
    folded = folds.kfold_roles(indexed.withColumnRenamed("fold", "_k"), cv, F.col("_k"))

    def score(name, params):
        scored = cross_predict(lambda t: models.fit_classifier(name, params, t, n_classes), folded, cv)
        per_fold = scored.groupBy("fold").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a"))
        return per_fold.agg(F.avg("a")).first()[0]

    names = [n for n in space if n not in set(exclude)]
    rows = _search(names, n_trials, space, seed, score)
    return data.sparkSession.createDataFrame(rows, RESULT).orderBy(*measure_order("best_score", ascending=False))


def search_regressors(
    data: DataFrame, n_trials: int = 50, cv: int = 3, exclude: Iterable[str] = (), seed: int = 42,
    space: Mapping[str, list[tuple]] = spaces.REGRESSOR_SPACES,
) -> DataFrame:
    """Maximise the negative mean squared error over a contiguous k-fold split."""
    indexed = data if "rn" in data.columns else folds.with_day_index(data)
    folded = folds.kfold_roles(indexed, cv, folds.contiguous_fold(cv))

    def score(name, params):
        scored = cross_predict(lambda t: models.fit_regressor(name, params, t), folded, cv)
        e = F.col("label") - F.col("prediction")
        return -scored.groupBy("fold").agg(F.avg(e * e).alias("m")).agg(F.avg("m")).first()[0]

    names = [n for n in space if n not in set(exclude)]
    rows = _search(names, n_trials, space, seed, score)
    return data.sparkSession.createDataFrame(rows, RESULT).orderBy(*measure_order("best_score", ascending=False))


def _chosen(results: DataFrame) -> list[tuple[str, dict]]:
    """Names and parameters of the fixed, short list of models."""
    return [(r["model"], dict(r["best_params"])) for r in results.select("model", "best_params").toLocalIterator()]


def evaluate_classifiers(data: DataFrame, results: DataFrame, n_classes: int, cv: int = 3) -> DataFrame:
    """Refit the chosen settings under an expanding split: accuracy, macro precision and recall, one-vs-one AUC."""
    indexed = data if "rn" in data.columns else folds.with_day_index(data)
    folded = folds.expanding_roles(indexed, cv)

    def one(name, params):
        scored = cross_predict(lambda t: models.fit_classifier(name, params, t, n_classes), folded, cv)
        return scored.select(
            F.lit(name).alias("model"), F.lit(params_json(params)).alias("best_params"), "fold", F.col("label").cast("int").alias("label"), "prediction", "probs"
        )

    parts = run_parallel([(lambda n=n, p=p: one(n, p)) for n, p in _chosen(results)])
    scored = _union(parts)
    keys = ["model", "best_params", "fold"]
    scores = metrics.classification_scores(scored, keys, "label", "prediction").join(metrics.auc_one_vs_one(scored, keys), keys, "left")
    board = metrics.classification_leaderboard(scores, ["model", "best_params"])
    return board.orderBy(*measure_order("accuracy"))


def evaluate_regressors(data: DataFrame, results: DataFrame, cv: int = 3) -> DataFrame:
    """Refit the chosen settings under a contiguous k-fold split."""
    indexed = data if "rn" in data.columns else folds.with_day_index(data)
    folded = folds.kfold_roles(indexed, cv, folds.contiguous_fold(cv))

    def one(name, params):
        scored = cross_predict(lambda t: models.fit_regressor(name, params, t), folded, cv)
        return scored.select(F.lit(name).alias("model"), F.lit(params_json(params)).alias("best_params"), "fold", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))

    parts = run_parallel([(lambda n=n, p=p: one(n, p)) for n, p in _chosen(results)])
    scores = metrics.fold_regression_scores(_union(parts), ["model", "best_params", "fold"])
    return metrics.regression_leaderboard(scores, ["model", "best_params"]).orderBy(*measure_order("mse"))


def params_json(params: Mapping) -> str:
    import json

    return json.dumps(dict(sorted(_as_text(params).items())))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
