"""Aligning forecasts with actuals and scoring them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from meterloom.operators.metrics import NEAR_ZERO

KEYS = ("series_id",)


def _to_second(ts: str):
    """Stamp cut to whole seconds."""
    c = F.col(ts)
    return c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), c) - F.second(c))


def align_by_second(actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join on the stamp at second resolution; rows that share a second pair up with each other."""
    a = actual.dropna(subset=["actual"]).select(*keys, _to_second("ts").alias("ts"), "actual")
    f = forecast.dropna(subset=["ts"]).select(*keys, _to_second("ts").alias("ts"), "predicted")
    return a.join(f, [*keys, "ts"])


def diagnostics_by_second(actual: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All diagnostics over the pairs of :func:`align_by_second`, without making the pairs.

    A second with p actuals and q forecasts stands for p * q pairs, but sums over them follow from sums on either side: counts,
    totals and squares multiply out, and the summed distance of an actual to the q forecasts comes from running sums over the values
    in order. Equal values of a second are counted first, so a stamp that repeats a value costs one row.
    """
    keys = list(keys)
    second = [*keys, "ts"]
    a = actual.dropna(subset=["actual"]).select(*keys, _to_second("ts").alias("ts"), F.col("actual").cast("double").alias("v"), F.lit(1).alias("is_a"))
    f = forecast.dropna(subset=["ts", "predicted"]).select(*keys, _to_second("ts").alias("ts"), F.col("predicted").cast("double").alias("v"), F.lit(0).alias("is_a"))
    counted = a.unionByName(f).groupBy(*second, "v").agg(F.sum("is_a").alias("na"), F.sum(1 - F.col("is_a")).alias("nf"))
    here = Window.partitionBy(*second)
    upto = here.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    v, na, nf = F.col("v"), F.col("na"), F.col("nf")
    walked = counted.withColumns({
        "p": F.sum(na).over(here), "q": F.sum(nf).over(here), "sf": F.sum(nf * v).over(here), "below": F.sum(nf).over(upto), "sum_below": F.sum(nf * v).over(upto)})
    both = walked.filter("p > 0 AND q > 0")
    # The summed distance of one actual to all forecasts of its second.
    gap = v * F.col("below") - F.col("sum_below") + (F.col("sf") - F.col("sum_below")) - v * (F.col("q") - F.col("below"))
    # Squares are taken about the mean of the pairs' actuals, so that a large level costs no digits.
    centre = both.groupBy(*keys).agg((F.sum(na * F.col("q") * v) / F.sum(na * F.col("q"))).alias("c"))
    moved = both.join(centre, keys).withColumns({"u": v - F.col("c"), "gap": gap})
    u = F.col("u")
    seconds = moved.groupBy(*second).agg(
        F.first("c").alias("c"), F.sum(na).cast("double").alias("p"), F.sum(nf).cast("double").alias("q"), F.sum(na * u).alias("a1"), F.sum(na * u * u).alias("a2"),
        F.sum(nf * u).alias("f1"), F.sum(nf * u * u).alias("f2"), F.sum(na * F.col("gap")).alias("abs"),
        F.sum(F.when(F.abs(v) > NEAR_ZERO, na * F.col("gap") / F.abs(v))).alias("rel"), F.sum(F.when(F.abs(v) > NEAR_ZERO, na)).alias("rel_n"),
        F.max(F.when(na > 0, u)).alias("a_hi"), F.min(F.when(na > 0, u)).alias("a_lo"), F.max(F.when(nf > 0, u)).alias("f_hi"), F.min(F.when(nf > 0, u)).alias("f_lo"))
    p, q = F.col("p"), F.col("q")
    total = seconds.groupBy(*keys).agg(
        F.first("c").alias("c"), F.sum(p * q).alias("n"), F.sum(q * F.col("a1")).alias("a1"), F.sum(q * F.col("a2")).alias("a2"), F.sum(p * F.col("f1")).alias("f1"),
        F.sum(p * F.col("f2")).alias("f2"), F.sum(F.col("a1") * F.col("f1")).alias("af"), F.sum("abs").alias("abs"), F.sum("rel").alias("rel"), F.sum(F.col("rel_n") * q).alias("rel_n"),
        F.max(F.greatest(F.col("a_hi") - F.col("f_lo"), F.col("f_hi") - F.col("a_lo"))).alias("max_error"))
    n = F.col("n")
    a_mean, f_mean = F.col("a1") / n, F.col("f1") / n
    a_var, f_var = F.greatest(F.col("a2") / n - a_mean * a_mean, F.lit(0.0)), F.greatest(F.col("f2") / n - f_mean * f_mean, F.lit(0.0))
    mse = F.greatest((F.col("a2") - 2 * F.col("af") + F.col("f2")) / n, F.lit(0.0))
    bias = a_mean - f_mean
    r2 = F.when(a_var == 0, F.when(mse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.lit(1.0) - F.try_divide(mse, a_var))
    return total.select(
        *keys, (F.col("abs") / n).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), r2.alias("r2"),
        (F.try_divide("rel", "rel_n") * 100.0).alias("mape"), (F.try_divide(F.sqrt(mse), F.nullif(a_mean + F.col("c"), F.lit(0.0))) * 100.0).alias("cv_rmse"),
        bias.alias("mean_residual"), F.sqrt(F.greatest(mse - bias * bias, F.lit(0.0))).alias("std_residual"), "max_error",
        (a_mean + F.col("c")).alias("actual_mean"), F.sqrt(a_var).alias("actual_std"), (f_mean + F.col("c")).alias("predicted_mean"), F.sqrt(f_var).alias("predicted_std"))


def evaluate_forecast(panel: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEYS, use_filter: bool = False) -> DataFrame:
    """All diagnostics of a forecast table; no overlap gives no row."""
    target = "total_filter" if use_filter and "total_filter" in panel.columns else "total"
    return diagnostics_by_second(panel.withColumnRenamed(target, "actual"), forecast, keys)
