"""Learners with closed forms, fitted for every series in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KEYS = ("series_id",)


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


# ---- linear regression by sums of products -----------------------------------------------------------------------


def _group_sums(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Per group ``n, sy, sx, sxy, sxx`` (packed upper triangle) and ``syy``, from one partly aggregated pass."""
    p = len(features)
    rows = train.dropna(subset=[*features, target])
    y = F.col(target).cast("double")
    cells = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    cells += [F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)]
    cells += [F.sum(F.col(f) * y).alias(f"y{i}") for i, f in enumerate(features)]
    cells += [F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*keys).agg(*cells)
    return sums.select(
        *keys, "n", "sy", F.array(*[f"s{i}" for i in range(p)]).alias("sx"), F.array(*[f"y{i}" for i in range(p)]).alias("sxy"),
        F.array(*[f"p{i}_{j}" for i in range(p) for j in range(i, p)]).alias("sxx"), "syy",
    )


def _key_fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)


def _centred(n: float, sy: float, sx, sxy, sxx) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of products about the means, and the sums of the features."""
    sx = np.asarray(sx, dtype=float)
    p = len(sx)
    gram = np.zeros((p, p))
    gram[np.triu_indices(p)] = sxx
    gram = gram + np.triu(gram, 1).T - np.outer(sx, sx) / n
    return gram, np.asarray(sxy, dtype=float) - sx * sy / n, sx


def linear_fit(train: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = KEYS, alpha: float = 0.0) -> DataFrame:
    """Least squares (``alpha`` = 0) or ridge per group: ``keys, intercept, coef, n``.

    One pass of partly aggregated sums; only the small solve per group runs in Python, batch by batch. The intercept is
    not penalised. Collinear columns get the minimum-norm solution.
    """
    packed = _group_sums(train, features, target, keys)

    def solve(batches):
        for b in batches:
            coefs, intercepts = [], []
            for n, sy, *sums in zip(b["n"], b["sy"], b["sx"], b["sxy"], b["sxx"]):
                gram, moment, sx = _centred(n, sy, *sums)
                if alpha > 0:
                    w = np.linalg.solve(gram + alpha * np.eye(len(sx)), moment)
                else:
                    w = np.linalg.lstsq(gram, moment, rcond=1e-12)[0]
                coefs.append(w)
                intercepts.append((sy - w @ sx) / n)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "intercept": intercepts, "coef": coefs, "n": b["n"].astype("int64")})

    return packed.mapInPandas(solve, f"{_key_fields(packed, keys)}, intercept double, coef array<double>, n bigint")


def descend(gram: np.ndarray, moment: np.ndarray, alpha: float, start: np.ndarray, sweeps: int = 100_000, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Lasso weights by cyclic coordinate descent with soft thresholds, from mean products about the mean.

    Also gives how far the optimality conditions are missed: the gradient is alpha times the sign where a weight is not 0, and at
    most alpha in size elsewhere.
    """
    w, size = start.copy(), np.diag(gram)
    live = np.flatnonzero(size > 1e-14 * max(size.max(initial=0.0), 1e-300))
    w[np.setdiff1d(np.arange(len(w)), live)] = 0.0
    gradient = moment - gram @ w
    scale = max(np.abs(moment).max(initial=0.0), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            rest = gradient[j] + size[j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / size[j]
            if new != w[j]:
                gradient -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * size[j])
                w[j] = new
        if moved <= tolerance * scale:
            break
    gradient = moment - gram @ w
    missed = np.where(w != 0, np.abs(gradient - alpha * np.sign(w)), np.maximum(np.abs(gradient) - alpha, 0.0))
    return w, float(missed[live].max(initial=0.0))


def lasso_fit(train: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Lasso per group and penalty: ``keys, alpha, intercept, coef, n, missed``.

    The objective is half the mean squared error plus alpha times the summed size of the weights; the intercept is free. All
    penalties come from the same sums, the largest first, each starting from the weights of the one before.
    """
    packed = _group_sums(train, features, target, keys)
    falling = sorted((float(a) for a in alphas), reverse=True)

    def solve(batches):
        for b in batches:
            out = []
            for i, (n, sy, *sums) in enumerate(zip(b["n"], b["sy"], b["sx"], b["sxy"], b["sxx"])):
                gram, moment, sx = _centred(n, sy, *sums)
                w = np.zeros(len(sx))
                for alpha in falling:
                    w, missed = descend(gram / n, moment / n, alpha, w)
                    out.append((*[b[k].iloc[i] for k in keys], alpha, (sy - w @ sx) / n, w, int(n), missed))
            yield pd.DataFrame(out, columns=[*keys, "alpha", "intercept", "coef", "n", "missed"])

    return packed.mapInPandas(solve, f"{_key_fields(packed, keys)}, alpha double, intercept double, coef array<double>, n bigint, missed double")


def linear_predict(df: DataFrame, model: DataFrame, features: Sequence[str], keys: Sequence[str] = KEYS, target: str = "prediction", clip: bool = False) -> DataFrame:
    """Add the fitted value; ``clip`` keeps it at or above zero."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    value = F.col("intercept") + _dot("coef", x)
    if clip:
        value = F.greatest(value, F.lit(0.0))
    return df.join(model.drop("n", "missed"), list(keys)).withColumn(target, value).drop("intercept", "coef")


# ---- Gaussian naive Bayes ----------------------------------------------------------------------------------------


def bayes_fit(train: DataFrame, features: Sequence[str], label: str = "cluster", keys: Sequence[str] = KEYS, var_smoothing: float = 1e-9) -> DataFrame:
    """Class priors, means and variances per group. Every variance is raised by ``var_smoothing`` times the largest
    feature variance of the group."""
    moments = [F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features] + [F.var_pop(F.col(f).cast("double")).alias(f"v_{f}") for f in features]
    per_class = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), *moments)
    widest = train.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.greatest(*[F.var_pop(F.col(f).cast("double")) for f in features]).alias("widest")
    )
    joined = per_class.join(widest, list(keys))
    spread = F.lit(var_smoothing) * F.col("widest")
    return joined.select(
        *keys, F.col(label).cast("int").alias("label"), (F.col("n") / F.col("total")).alias("prior"),
        F.array(*[f"m_{f}" for f in features]).alias("mean"), F.array(*[F.col(f"v_{f}") + spread for f in features]).alias("var"),
    )


def bayes_predict(df: DataFrame, model: DataFrame, features: Sequence[str], n_classes: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``prediction`` and ``probs`` (by class label). The classes of a group travel as one short array."""
    table = model.groupBy(*keys).agg(F.collect_list(F.struct("label", "prior", "mean", "var")).alias("_classes"))
    x = F.array(*[F.col(f).cast("double") for f in features])

    def log_density(c):
        gaps = F.zip_with(F.zip_with(F.col("_x"), c["mean"], lambda v, m: (v - m) * (v - m)), c["var"], lambda g, s: F.log(s * (2 * np.pi)) + g / s)
        return F.log(c["prior"]) - F.aggregate(gaps, F.lit(0.0), lambda a, v: a + v) / 2.0

    scored = F.transform("_classes", lambda c: F.struct(log_density(c).alias("s"), (-c["label"]).alias("o"), c["label"].alias("label")))
    joined = df.withColumn("_x", x).join(table, list(keys))
    best = joined.withColumn("_s", scored).withColumn("_best", F.array_max("_s"))
    weights = best.withColumn("_w", F.transform("_s", lambda s: F.struct(s["label"].alias("label"), F.exp(s["s"] - F.col("_best.s")).alias("w"))))
    total = F.aggregate("_w", F.lit(0.0), lambda a, w: a + w["w"])
    probs = F.transform(
        F.sequence(F.lit(0), F.lit(n_classes - 1)),
        lambda c: F.aggregate(F.filter("_w", lambda w: w["label"] == c), F.lit(0.0), lambda a, w: a + w["w"]) / F.col("_total"),
    )
    return (
        weights.withColumn("_total", total).withColumn("prediction", F.col("_best.label")).withColumn("probs", probs)
        .drop("_x", "_classes", "_s", "_best", "_w", "_total")
    )
