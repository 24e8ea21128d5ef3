"""Benchmark models against actual load: persistence, ARMA-error regressions and an additive seasonal model.

The hold-out part is fold 0, cross-validation folds count from 1. Every fold has its own scaler and trend knots, taken from
the rows before its start, and a day is forecast from all rows before it (for a fold that starts inside a day: before
that start). All folds of a model come from one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.encode import fourier_terms
from meterloom.functions.timeaxis import SLOTS_PER_DAY, SLOTS_PER_WEEK, minute_of_day, minute_of_week
from meterloom.operators import metrics
from meterloom.operators.ranking import leaderboard
from meterloom.operators.rowframe import with_row_index
from meterloom.plans.persistence import LAST_DAY, LAST_WEEK, with_persistence
from meterloom.plans.walkforward import LONG_AR, Design, Term, walk_forward
from meterloom.session import materialise
from meterloom.sources.holidays import with_holiday_flag

# Model names, and the output column of each model.
ARMA_WEEKLY, ARMA_FULL, ADDITIVE = "ARIMA + Fourier", "ARIMAX Full", "Additive"
COLUMNS = {LAST_DAY: "Last_Day", LAST_WEEK: "Last_Week", ARMA_WEEKLY: "ARIMA_Fourier", ARMA_FULL: "ARIMAX_Full", ADDITIVE: "Additive"}
REGRESSORS = ["temperature", "radiation", "weekday", "is_weekend", "is_holiday"]
# Additive model (knots, share of the history they span, orders of the weekly and daily terms, prior
# scales of the trend changes and of all other terms, assumed noise level).
KNOTS, KNOT_SPAN, WEEKLY_ORDER, DAILY_ORDER = 25, 0.8, 3, 4
TREND_SCALE, TERM_SCALE, NOISE = 0.05, 10.0, 0.1
DAY_MICROS = 86_400_000_000.0
#: Needs weights from outside and is not built: it appears in tables of measures only, without values.
ZERO_SHOT = "Zero-shot"


def benchmark_rows(panel: DataFrame, value: str = "total", holidays: DataFrame | None = None) -> DataFrame:
    """Rows with position and calendar flags. Every row has a position, whether it has a load or not."""
    rows = with_row_index(panel.drop("date", "ordinal", "rn", "series_rows").select("series_id", "ts", F.col(value).alias("total"), "temperature", "radiation"))
    return with_holiday_flag(rows, holidays).withColumns(
        {
            "is_holiday": F.col("is_holiday").cast("double"),
            "weekday": F.weekday("ts").cast("double"),
            "is_weekend": (F.weekday("ts") >= 5).cast("double"),
        }
    )


def fold_frames(rows: DataFrame, test_start: str, splits: int = 0) -> DataFrame:
    """Per series ``folds`` and ``t0``: where each fold begins and ends (row positions), mean and population deviation of the
    regressors before it, and the knots and span (in days) of its history."""
    count = rows.groupBy("series_id").agg(F.max("series_rows").alias("n"), F.count_if(F.col("ts") < F.lit(test_start).cast("timestamp_ntz")).alias("s0"))
    size = F.floor(F.col("n") / (splits + 1))
    starts = count.select("series_id", F.col("n").alias("stop0"), "s0", *[
        e for f in range(1, splits + 1) for e in ((F.col("n") - size * (splits + 1 - f)).alias(f"s{f}"), (F.col("n") - size * (splits - f)).alias(f"stop{f}"))])
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    aggs = [F.min(micros).alias("t0")]
    for f in range(splits + 1):
        before = F.col("rn") < F.col(f"s{f}")
        aggs.append(F.max(F.when(before, micros)).alias(f"t1_{f}"))
        for c in REGRESSORS:
            aggs += [F.avg(F.when(before, F.col(c))).alias(f"{c}_mean{f}"), F.stddev_pop(F.when(before, F.col(c))).alias(f"{c}_sd{f}")]
    edges = [c for f in range(splits + 1) for c in (f"s{f}", f"stop{f}")]
    wide = rows.join(starts, "series_id").groupBy("series_id", *edges).agg(*aggs)

    def frame(f: int) -> Column:
        span = F.col(f"t1_{f}") - F.col("t0")
        knots = [(F.col("t0") + F.round(span * F.lit(k)).cast("long")) for k in _knot_places()]
        return F.struct(
            F.lit(f).alias("fold"), F.col(f"s{f}").cast("long").alias("start"), F.col(f"stop{f}").cast("long").alias("stop"),
            F.array(*[F.col(f"{c}_mean{f}") for c in REGRESSORS]).alias("means"), F.array(*[F.col(f"{c}_sd{f}") for c in REGRESSORS]).alias("sds"),
            (span / F.lit(DAY_MICROS)).alias("span"), F.coalesce(F.when(span > 0, F.array(*knots)), F.array().cast("array<bigint>")).alias("knots"))

    return wide.select("series_id", "t0", F.array(*[frame(f) for f in range(splits + 1)]).alias("folds"))


def _knot_places() -> list[float]:
    return [KNOT_SPAN * (i + 1) / KNOTS for i in range(KNOTS)]


def _cut_rows(rows: DataFrame, frames: DataFrame, knots: bool = False) -> DataFrame:
    """Add ``part``: days are cut where a fold begins or ends, and at the knots of all folds if ``knots``. Also ``day_time``, days
    since the start of the series."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.aggregate("folds", F.lit(0), lambda s, f: s + (F.col("rn") >= f["start"]).cast("int") + (F.col("rn") >= f["stop"]).cast("int"))
    if knots:
        part = part + F.aggregate("folds", F.lit(0), lambda s, f: s + F.size(F.filter(f["knots"], lambda k: k <= micros)))
    # One row per series: the planner broadcasts it below its threshold and splits hot series beyond.
    return rows.join(frames, "series_id").withColumns({"part": part, "day_time": (micros - F.col("t0")) / F.lit(DAY_MICROS)}).drop("folds", "t0")


def _regressors(first: int) -> tuple[list[Column], list[Term]]:
    """Raw columns (values, and flags of the readings that exist) and scaled terms; a missing reading counts as an average one."""
    columns, terms = [], []
    for i, c in enumerate(REGRESSORS):
        columns += [F.coalesce(F.col(c), F.lit(0.0)), F.col(c).isNotNull().cast("double")]
        terms.append(Term("scaled", first + 2 * i, 0.0, known=first + 2 * i + 1, stat=i))
    return columns, terms


def _weighted(terms: Sequence[Term], penalty: float) -> list[Term]:
    return [replace(t, penalty=penalty) for t in terms]


def _arma_design(period: int, order: int, regressors: bool) -> Design:
    """Harmonics of the row position, and the regressors if wanted.

    The light ridge is worth about two rows of data per term and nothing for the level: it fades with the history, but keeps
    terms in check that a short history cannot tell apart, such as weekly harmonics on two days.
    """
    columns = [F.lit(1.0), *fourier_terms("rn", period, order).values()]
    terms = [Term("plain", i, 1.0) for i in range(1, len(columns))]
    if regressors:
        more, scaled = _regressors(len(columns))
        columns, terms = columns + more, terms + _weighted(scaled, 1.0)
    return Design(columns, [Term("plain", 0, 1e-6), *terms])


def _harmonics(phase: Column, order: int) -> list[Column]:
    out = []
    for k in range(1, order + 1):
        out += [F.sin(F.lit(2 * math.pi * k) * phase), F.cos(F.lit(2 * math.pi * k) * phase)]
    return out


def _additive_design() -> Design:
    """Piecewise-linear trend, weekly and daily terms and regressors. Time is scaled to the fold's history, and the trend's
    knots lie evenly in the first part of it."""
    columns = [F.lit(1.0), F.col("day_time"), *_harmonics(minute_of_week("ts") / F.lit(10080.0), WEEKLY_ORDER), *_harmonics(minute_of_day("ts") / F.lit(1440.0), DAILY_ORDER)]
    loose, tight = (NOISE / TERM_SCALE) ** 2, (NOISE / TREND_SCALE) ** 2
    more, scaled = _regressors(len(columns))
    trend = [Term("plain", 0, 1e-6), Term("time", 1, loose), *[Term("hinge", 1, tight, knot=i, at=k) for i, k in enumerate(_knot_places())]]
    return Design(columns + more, [*trend, *[Term("plain", i, loose) for i in range(2, len(columns))], *_weighted(scaled, loose)])


def arma_weekly(rows: DataFrame, frames: DataFrame, order: int = 10) -> DataFrame:
    """ARMA(2,1) errors around weekly harmonics; one row for each fold that tests it."""
    return walk_forward(_cut_rows(rows, frames), _arma_design(SLOTS_PER_WEEK, order, False), frames, lags=LONG_AR + 1).filter("fold is not null")


def arma_full(rows: DataFrame, frames: DataFrame, order: int = 5) -> DataFrame:
    """ARMA(2,1) errors around daily harmonics, scaled weather and scaled calendar flags."""
    return walk_forward(_cut_rows(rows, frames), _arma_design(SLOTS_PER_DAY, order, True), frames, lags=LONG_AR + 1).filter("fold is not null")


def additive(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Piecewise trend, weekly and daily seasons and regressors, as one penalised regression."""
    return walk_forward(_cut_rows(rows, frames, knots=True), _additive_design(), frames).filter("fold is not null")


def _persistence(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Both persistence forecasts of the tested rows."""
    p = with_persistence(rows)
    tested = p.join(frames.select("series_id", F.explode("folds").alias("f")), "series_id").filter((F.col("rn") >= F.col("f.start")) & (F.col("rn") < F.col("f.stop")))
    return tested.withColumn("fold", F.col("f.fold")).drop("f")


def benchmark_forecasts(panel: DataFrame, test_start: str, value: str = "total", models: Sequence[str] = tuple(COLUMNS), splits: int = 0) -> DataFrame:
    """Day-ahead forecasts: series_id, ts, rn, fold, model, actual, predicted.

    Fold 0 is the hold-out part from ``test_start`` on; ``splits`` adds the folds of an expanding split over row positions.
    """
    # Stored once: every model below reads these tables several times.
    rows = materialise(benchmark_rows(panel, value), "benchmark-rows")
    frames = materialise(fold_frames(rows, test_start, splits), "fold-frames")
    parts = []
    if LAST_DAY in models or LAST_WEEK in models:
        p = _persistence(rows, frames)
        parts += [(m, p.withColumn("predicted", F.col(c))) for m, c in ((LAST_DAY, "last_day"), (LAST_WEEK, "last_week")) if m in models]
    for name, model in ((ARMA_WEEKLY, arma_weekly), (ARMA_FULL, arma_full), (ADDITIVE, additive)):
        if name in models:
            parts.append((name, model(rows, frames)))
    out = None
    for name, df in parts:
        one = df.select("series_id", "ts", "rn", "fold", F.lit(name).alias("model"), F.col("total").alias("actual"), "predicted")
        out = one if out is None else out.unionByName(one)
    return out


def holdout_table(forecasts: DataFrame, models: Sequence[str] = ()) -> DataFrame:
    """Measures of the hold-out part per model, ranked by RMSE. ``models`` that gave no forecast stand last, with null measures
    and no valid samples."""
    tested = forecasts.filter("fold = 0")
    measured = metrics.benchmark_metrics(tested, ["series_id", "model"])
    if models:
        rows = tested.groupBy("series_id", "model").count().groupBy("series_id").agg(F.max("count").alias("_rows"))
        expected = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
        measured = metrics.with_missing_models(measured, expected, ["series_id", "model"]).withColumn("total_samples", F.coalesce("total_samples", "_rows")).drop("_rows")
    return leaderboard(measured, "rmse", ["series_id"])


def wide_predictions(forecasts: DataFrame, models: Sequence[str] = tuple(COLUMNS)) -> DataFrame:
    """Actual and one column per model over the hold-out part."""
    aggs = [F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(COLUMNS[m]) for m in models]
    return forecasts.filter("fold = 0").groupBy("series_id", "ts").agg(F.max("actual").alias("Actual"), *aggs)


def cv_details(forecasts: DataFrame) -> DataFrame:
    """Measures per model and cross-validation fold."""
    return metrics.benchmark_metrics(forecasts.filter("fold > 0"), ["series_id", "model", "fold"])


def cv_table(details: DataFrame) -> DataFrame:
    return metrics.cv_summary(details, ["series_id", "model"], ["r2", "mae", "rmse", "wmape"])
