"""Accuracy measures as aggregate expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: actuals closer to zero than this do not enter percentage errors.
NEAR_ZERO = 1e-10
# Fixed value: double-precision machine epsilon, the denominator floor of the fold MAPE.
EPSILON = 2.220446049250313e-16


def r_squared(a: Column, p: Column) -> Column:
    """1 - SSE/SST from one pass; a constant actual gives 1 for a perfect forecast and 0 otherwise."""
    both = a.isNotNull() & p.isNotNull()
    aa, pp = F.when(both, a), F.when(both, p)
    sse = F.sum((aa - pp) * (aa - pp))
    sst = F.var_pop(aa) * F.count(aa)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) - sse / F.nullif(sst, F.lit(0.0)))


def _err(a: Column, p: Column) -> Column:
    return a - p


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(_err(a, p)))


def mse(a: Column, p: Column) -> Column:
    return F.avg(_err(a, p) * _err(a, p))


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(mse(a, p))


def masked_mape(a: Column, p: Column) -> Column:
    """Mean absolute percentage error over the actuals that are not near zero."""
    return F.avg(F.when(F.abs(a) > NEAR_ZERO, F.abs((a - p) / F.nullif(a, F.lit(0.0))))) * 100.0


def floored_mape(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p) / F.greatest(F.abs(a), F.lit(EPSILON))) * 100.0


def wmape(a: Column, p: Column) -> Column:
    """Summed absolute error over summed absolute actuals, in percent."""
    both = a.isNotNull() & p.isNotNull()
    return F.try_divide(F.sum(F.abs(a - p)), F.sum(F.when(both, F.abs(a)))) * 100.0


def wmape_signed(a: Column, p: Column) -> Column:
    """Summed absolute error over the plain sum of actuals, in percent."""
    both = a.isNotNull() & p.isNotNull()
    return F.try_divide(F.sum(F.abs(a - p)), F.sum(F.when(both, a))) * 100.0


def hybrid_metrics(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Measures of the shape x peak forecast (signed WMAPE)."""
    a, p = F.col(actual), F.col(predicted)
    return pairs.groupBy(*keys).agg(
        r_squared(a, p).alias("r2"), mae(a, p).alias("mae"), mse(a, p).alias("mse"), rmse(a, p).alias("rmse"),
        wmape_signed(a, p).alias("wmape_signed"),
    )


def benchmark_metrics(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Measures over the pairs where both sides exist; no row when there is no such pair."""
    a, p = F.col(actual), F.col(predicted)
    both = a.isNotNull() & p.isNotNull()
    return (
        pairs.groupBy(*keys)
        .agg(
            r_squared(a, p).alias("r2"), mae(a, p).alias("mae"), rmse(a, p).alias("rmse"), masked_mape(a, p).alias("mape"),
            wmape(a, p).alias("wmape"), F.count_if(both).alias("valid_samples"), F.count(F.lit(1)).alias("total_samples"),
        )
        .filter("valid_samples > 0")
    )


def with_missing_models(metrics: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected models without a result appear with null measures and zero valid samples."""
    out = expected.join(metrics, list(keys), "left")
    return out.withColumn("valid_samples", F.coalesce("valid_samples", F.lit(0)))


def full_diagnostics(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """All diagnostics of a finished forecast."""
    a, p = F.col(actual), F.col(predicted)
    e = a - p
    return (
        pairs.filter(a.isNotNull() & p.isNotNull())
        .groupBy(*keys)
        .agg(
            mae(a, p).alias("mae"), mse(a, p).alias("mse"), rmse(a, p).alias("rmse"), r_squared(a, p).alias("r2"),
            masked_mape(a, p).alias("mape"),
            (F.try_divide(rmse(a, p), F.nullif(F.avg(a), F.lit(0.0))) * 100.0).alias("cv_rmse"),
            F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"), F.max(F.abs(e)).alias("max_error"),
            F.avg(a).alias("actual_mean"), F.stddev_pop(a).alias("actual_std"),
            F.avg(p).alias("predicted_mean"), F.stddev_pop(p).alias("predicted_std"),
        )
    )


def fold_regression_scores(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """R2, MAE, MSE and MAPE of each fold."""
    a, p = F.col(actual), F.col(predicted)
    return pairs.groupBy(*keys).agg(
        r_squared(a, p).alias("r2"), mae(a, p).alias("mae"), mse(a, p).alias("mse"), floored_mape(a, p).alias("mape")
    )


def regression_leaderboard(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold means; RMSE is the root of the mean MSE and the R2 spread is the population deviation."""
    return folds.groupBy(*keys).agg(
        F.avg("r2").alias("r2"), F.avg("mae").alias("mae"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"),
        F.avg("mape").alias("mape"), F.stddev_pop("r2").alias("r2_std"),
    )


def confusion(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pairs.groupBy(*keys, actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def classification_scores(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy, macro precision and macro recall over the labels seen on either side; an absent class counts 0."""
    cells = confusion(pairs, keys, actual, predicted)
    hit = F.col(actual) == F.col(predicted)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col(actual).alias("label"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), zero.alias("fp"),
            F.when(~hit, F.col("n")).otherwise(zero).alias("fn"),
        ),
        F.struct(
            F.col(predicted).alias("label"), zero.alias("tp"), F.when(~hit, F.col("n")).otherwise(zero).alias("fp"), zero.alias("fn"),
        ),
    )
    per_label = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.label")
        .agg(F.sum("s.tp").alias("tp"), F.sum("s.fp").alias("fp"), F.sum("s.fn").alias("fn"))
    )
    share = lambda extra: F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col(extra)), F.lit(0.0))
    return per_label.groupBy(*keys).agg(
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.avg(share("fp")).alias("precision"),
        F.avg(share("fn")).alias("recall"),
    )


def auc_one_vs_one(scores: DataFrame, keys: Sequence[str], label: str = "label", probs: str = "probs", pieces: int = 200) -> DataFrame:
    """Macro one-vs-one ROC AUC. ``probs`` is an array of scores indexed by class number.

    Mid-ranks without a global sort: equal scores are counted together first, the score axis is cut into pieces at
    approximate quantiles, and the running count of negatives is the pieces before plus a window inside the piece. The
    result is exact wherever the cuts fall.
    """
    others = F.filter(F.sequence(F.lit(0), F.size(probs) - 1), lambda c: c != F.col(label))
    sides = F.flatten(
        F.transform(
            others,
            lambda c: F.array(
                F.struct(
                    F.col(label).cast("int").alias("pos"), c.cast("int").alias("neg"),
                    F.element_at(probs, F.col(label) + 1).alias("score"), F.lit(1).alias("hit"),
                ),
                F.struct(
                    c.cast("int").alias("pos"), F.col(label).cast("int").alias("neg"),
                    F.element_at(probs, c + 1).alias("score"), F.lit(0).alias("hit"),
                ),
            ),
        )
    )
    on = [*keys, "pos", "neg"]
    counted = (
        scores.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.pos").alias("pos"), F.col("s.neg").alias("neg"), F.col("s.score").alias("score"))
        .agg(F.sum("s.hit").alias("hits"), F.sum(F.lit(1) - F.col("s.hit")).alias("misses"))
    )
    marks = [i / pieces for i in range(1, pieces)]
    cuts = counted.groupBy(*on).agg(F.percentile_approx("score", marks, 1000).alias("cuts"))
    piece = F.size(F.filter("cuts", lambda c: c < F.col("score")))
    cut = counted.join(cuts, on).withColumn("piece", piece).drop("cuts")
    totals = cut.groupBy(*on, "piece").agg(F.sum("misses").alias("_m"))
    before = Window.partitionBy(*on).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*on, "piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("below_piece"))
    inside = Window.partitionBy(*on, "piece").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.withColumn("below", F.coalesce(F.sum("misses").over(inside), F.lit(0))).join(offsets, [*on, "piece"])
    wins = F.col("hits") * (F.col("below") + F.col("below_piece") + F.col("misses") / F.lit(2.0))
    directed = ranked.groupBy(*on).agg(
        F.try_divide(F.sum(wins), (F.sum("hits") * F.sum("misses")).cast("double")).alias("auc")
    )
    return directed.filter("auc is not null").groupBy(*keys).agg(F.avg("auc").alias("roc_auc"))


def classification_leaderboard(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold means with the population deviation of accuracy."""
    aggs = [F.avg("accuracy").alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
            F.stddev_pop("accuracy").alias("accuracy_std")]
    if "roc_auc" in folds.columns:
        aggs.append(F.avg("roc_auc").alias("roc_auc"))
    return folds.groupBy(*keys).agg(*aggs)


def cv_summary(folds: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over the folds; one fold has no deviation."""
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return folds.groupBy(*keys).agg(*aggs)
