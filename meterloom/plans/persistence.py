"""Persistence forecasts: the value one day or one week of rows earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meterloom.functions.timeaxis import SLOTS_PER_DAY, SLOTS_PER_WEEK
from meterloom.operators.metrics import benchmark_metrics
from meterloom.operators.rowframe import lag_frame, with_frames, with_row_index

LAST_DAY, LAST_WEEK = "Last Day", "Last Week"


def with_persistence(panel: DataFrame, value: str = "total", day_rows: int = SLOTS_PER_DAY, week_rows: int = SLOTS_PER_WEEK) -> DataFrame:
    rows = panel if "rn" in panel.columns else with_row_index(panel)
    return with_frames(rows, {"last_day": lag_frame(value, day_rows), "last_week": lag_frame(value, week_rows)})


def persistence_forecasts(panel: DataFrame, value: str = "total") -> DataFrame:
    """Long table: series_id, ts, model, actual, predicted. Both lags come out of one shuffle."""
    rows = with_persistence(panel, value)
    models = F.array(
        F.struct(F.lit(LAST_DAY).alias("model"), F.col("last_day").alias("predicted")),
        F.struct(F.lit(LAST_WEEK).alias("model"), F.col("last_week").alias("predicted")),
    )
    keep = [c for c in ("rn", "series_rows", "date") if c in rows.columns]
    return rows.select("series_id", "ts", *keep, F.col(value).alias("actual"), F.explode(models).alias("m")).select(
        "series_id", "ts", *keep, "m.model", "actual", "m.predicted"
    )


def persistence_backtest(panel: DataFrame, test_start: str, value: str = "total") -> DataFrame:
    """Benchmark measures per series and model from ``test_start`` on. Lags reach back across the split."""
    tested = persistence_forecasts(panel, value).filter(F.col("ts") >= F.lit(test_start).cast("timestamp_ntz"))
    return benchmark_metrics(tested, ["series_id", "model"])
