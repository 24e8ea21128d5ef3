"""The walk-forward engine against a plain pass over all earlier rows at every origin."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import twin_frame
from meterloom.operators.rowframe import with_row_index
from meterloom.plans import benchmark, persistence, walkforward
from meterloom.session import materialise

SCHEMA = "series_id string, ts timestamp_ntz, temperature double, radiation double, total double, total_filter double"


def holey(days, seed=3):
    """Two meters; some loads and readings are missing, whole hours among them, and one meter lacks a day."""
    p = twin_frame(days, missing_day=2, seed=seed)
    p = p[p["series_id"] != "m3"].reset_index(drop=True)
    rng = np.random.default_rng(seed)
    p.loc[rng.choice(len(p), len(p) // 30, replace=False), "total"] = np.nan
    p.loc[200:203, "total"] = np.nan
    return p


def to_spark(spark, p):
    clean = p.astype(object).where(p.notna(), None)
    return materialise(spark.createDataFrame(clean, SCHEMA), "holey")



def plain_forecasts(p, fold_start, fold_stop, model):
    """Forecasts of rows ``fold_start..fold_stop`` of one series, refitting on all earlier rows at each origin."""
    p = p.sort_values("ts").reset_index(drop=True)
    n = len(p)
    rn, y = np.arange(n), p["total"].to_numpy(float)
    regs = np.column_stack([p["temperature"], p["radiation"], p["ts"].dt.weekday, p["ts"].dt.weekday >= 5, p["ts"].dt.strftime("%m-%d") == "01-06"]).astype(float)
    mean, sd = np.nanmean(regs[:fold_start], 0), np.nanstd(regs[:fold_start], 0)
    scaled = np.nan_to_num((regs - mean) / np.where(sd == 0, 1, sd))
    waves = lambda t, period, order: [f(2 * np.pi * k * t / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]
    if model == benchmark.ARMA_WEEKLY:
        x = np.column_stack([np.ones(n), *waves(rn, 672, 10)])
        penalty = np.r_[1e-6, np.ones(20)]
    elif model == benchmark.ARMA_FULL:
        x = np.column_stack([np.ones(n), *waves(rn, 96, 5), scaled])
        penalty = np.r_[1e-6, np.ones(15)]
    else:
        t = (p["ts"] - p["ts"].iloc[0]).dt.total_seconds().to_numpy()
        t = t / t[fold_start - 1]
        hinges = [np.maximum(t - 0.8 * (i + 1) / 25, 0) for i in range(25)]
        minute = (p["ts"].dt.hour * 60 + p["ts"].dt.minute).to_numpy()
        week = (p["ts"].dt.weekday * 1440).to_numpy() + minute
        x = np.column_stack([np.ones(n), t, *hinges, *waves(week, 10080, 3), *waves(minute, 1440, 4), scaled])
        loose, tight = (0.1 / 10) ** 2, (0.1 / 0.05) ** 2
        penalty = np.r_[1e-6, loose, [tight] * 25, [loose] * 19]
    out, day, known = np.full(n, np.nan), p["ts"].dt.normalize(), ~np.isnan(y)
    for d in day[fold_start:fold_stop].unique():
        now = np.flatnonzero((day == d) & (rn >= fold_start) & (rn < fold_stop))
        o = now[0]
        xs, ys = x[:o][known[:o]], y[:o][known[:o]]
        beta = np.linalg.solve(xs.T @ xs + np.diag(penalty), xs.T @ ys)
        out[now] = x[now] @ beta
        if model != benchmark.ADDITIVE:
            u = np.where(known[:o], np.nan_to_num(y[:o]) - x[:o] @ beta, 0.0)
            g = np.array([u[l:] @ u[: o - l] for l in range(22)]) / known[:o].sum()
            (phi1, phi2, theta), flt = walkforward.arma21_from_autocovariances(g)
            a, b, shock = u[-1], u[-2], theta * (flt @ u[::-1][:21])
            for i in now:
                a, b, shock = phi1 * a + phi2 * b + shock, a, 0.0
                out[i] += a
    return out[fold_start:fold_stop]


@pytest.mark.parametrize("days,splits", [(5, 2), (30, 3)])
def test_every_fold_equals_a_refit_at_each_origin(spark, days, splits):
    p = holey(days)
    start = str((p["ts"].min() + pd.Timedelta(days=days - 2, hours=6 if days == 30 else 0)))
    models = [benchmark.ARMA_WEEKLY, benchmark.ARMA_FULL, benchmark.ADDITIVE]
    made = benchmark.benchmark_forecasts(to_spark(spark, p), start, models=models, splits=splits).toPandas()
    for series, own in p.groupby("series_id"):
        own = own.sort_values("ts").reset_index(drop=True)
        n = len(own)
        size = n // (splits + 1)
        bounds = {0: (int((own["ts"] < start).sum()), n)} | {f: (n - size * (splits + 1 - f), n - size * (splits - f)) for f in range(1, splits + 1)}
        for model in models:
            for fold, (lo, hi) in bounds.items():
                got = made[(made["series_id"] == series) & (made["model"] == model) & (made["fold"] == fold)].sort_values("rn")
                assert got["rn"].tolist() == list(range(lo, hi))
                np.testing.assert_allclose(got["predicted"].to_numpy(float), plain_forecasts(own, lo, hi, model), rtol=1e-5, atol=1e-5, err_msg=f"{series} {model} {fold}")


def test_rows_after_a_fold_do_not_change_it(spark):
    p = holey(16)
    later = p["ts"] >= p["ts"].min() + pd.Timedelta(days=13)
    q = p.copy()
    q.loc[later, ["total", "temperature", "radiation"]] = q.loc[later, ["total", "temperature", "radiation"]] * 40 + 9
    made = [benchmark.benchmark_forecasts(to_spark(spark, x), "2021-01-18", splits=3).filter("fold = 1 or fold = 2").toPandas().sort_values(["series_id", "model", "fold", "rn"]) for x in (p, q)]
    pd.testing.assert_frame_equal(made[0].reset_index(drop=True), made[1].reset_index(drop=True))


def test_planted_errors_are_found(spark):
    """ARMA(2,1) errors around a level, spread over input partitions in small batches."""
    rng = np.random.default_rng(11)
    n, phi1, phi2, theta = 96 * 1050, 0.9, -0.2, 0.4
    e, u = rng.normal(size=n), np.zeros(n)
    for t in range(2, n):
        u[t] = phi1 * u[t - 1] + phi2 * u[t - 2] + e[t] + theta * e[t - 1]
    p = pd.DataFrame({"series_id": "s", "ts": pd.date_range("2020-01-01", periods=n, freq="15min"), "total": 50 + u})
    rows = materialise(with_row_index(spark.createDataFrame(p, "series_id string, ts timestamp_ntz, total double")), "planted")
    design = walkforward.plain_design([F.lit(1.0)], 1e-6)
    runs = walkforward.day_runs(rows, design, lags=21).withColumn("folds", walkforward.one_fold())
    last = walkforward.walk(runs, design, lags=21).orderBy(F.col("date").desc()).first()
    np.testing.assert_allclose([last["phi1"], last["phi2"], last["theta"]], [phi1, phi2, theta], atol=0.02)
    assert abs(last["beta"][0] - 50) < 0.2 and last["known"] == n - 96


def test_runs_merge_to_one_pass_over_all_rows():
    rng = np.random.default_rng(1)
    z, lags = rng.normal(size=(60, 3)), 7
    whole = walkforward.Run.of(0, 0, z, 60, lags)
    for cuts in ([1, 2, 3, 30], [5, 10, 15], [59], [7, 14]):
        at = [0, *cuts, 60]
        parts = [walkforward.Run.of(a, 0, z[a:b], b - a, lags) for a, b in zip(at, at[1:])]
        made = parts[0]
        for x in parts[1:]:
            made = made.then(x)
        right = parts[-1]
        for x in parts[-2::-1]:
            right = x.then(right)
        for got in (made, right):
            np.testing.assert_allclose(got.sums, whole.sums, atol=1e-12)
            np.testing.assert_array_equal(got.head, whole.head)
            np.testing.assert_array_equal(got.tail, whole.tail)
    basis = rng.normal(size=(4, 2))
    np.testing.assert_allclose(whole.seen_by(basis).sums, walkforward.Run.of(0, 0, np.c_[z[:, :2] @ basis.T, z[:, 2]], 60, lags).sums, atol=1e-12)
    gap = walkforward.Run.of(0, 0, z[:5], 5, lags).then(walkforward.Run.of(9, 0, z[9:], 51, lags))
    np.testing.assert_allclose(gap.sums[1], walkforward.Run.of(0, 0, z[:5], 5, lags).sums[1] + walkforward.Run.of(9, 0, z[9:], 51, lags).sums[1])


def test_a_day_spread_over_partitions_and_batches_gives_the_same_forecast(spark, twin):
    rows = with_row_index(twin)
    design = [F.lit(1.0), F.col("radiation")]
    want = walkforward.walk_forward_linear(rows, design).select("series_id", "ts", "fitted").toPandas().sort_values(["series_id", "ts"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = walkforward.walk_forward_linear(rows.repartition(9), design).select("series_id", "ts", "fitted").toPandas().sort_values(["series_id", "ts"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    np.testing.assert_allclose(got["fitted"].to_numpy(float), want["fitted"].to_numpy(float), rtol=1e-9)


def test_no_design_row_is_shuffled(spark, twin):
    rows = materialise(with_row_index(twin), "rows")
    design = [F.lit(1.0), *[F.sin(F.col("rn") / F.lit(float(k))) for k in range(3, 12)]]
    plan = walkforward.walk_forward_linear(rows, design)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert below.index("MapInArrow") < below.index("z#")  # the repartition stands on reductions, not on rows


def test_benchmark_and_persistence_agree_where_loads_are_missing(spark):
    data = to_spark(spark, holey(12))
    start = "2021-01-13"
    made = benchmark.benchmark_forecasts(data, start, models=[persistence.LAST_DAY, persistence.LAST_WEEK])
    got = {(r["series_id"], r["model"]): r for r in benchmark.holdout_table(made).collect()}
    want = persistence.persistence_backtest(data, start).collect()
    assert len(want) == 4
    for w in want:
        for c in ("r2", "mae", "rmse", "mape", "wmape", "valid_samples", "total_samples"):
            assert got[w["series_id"], w["model"]][c] == pytest.approx(w[c])


def test_a_model_without_forecast_has_a_null_row(spark):
    data = to_spark(spark, holey(4))
    models = [persistence.LAST_DAY, persistence.LAST_WEEK]
    made = benchmark.benchmark_forecasts(data, "2021-01-07", models=models)
    rows = benchmark.holdout_table(made, (*models, benchmark.ZERO_SHOT)).filter("series_id = 'm1'").orderBy("place").collect()
    assert [(r["model"], r["valid_samples"], r["total_samples"], r["rmse"] is None) for r in rows][0][0] == persistence.LAST_DAY
    assert {(r["model"], r["valid_samples"], r["total_samples"], r["rmse"]) for r in rows[1:]} == {(persistence.LAST_WEEK, 0, 96, None), (benchmark.ZERO_SHOT, 0, 96, None)}
