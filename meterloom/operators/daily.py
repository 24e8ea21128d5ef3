"""Day tables and the feature sets of the day classifier and the peak regressor."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.encode import CYCLIC_COLUMNS, with_cyclic
from meterloom.functions.timeaxis import round_half_even, weekday_label
from meterloom.operators.rowframe import TRAILING_WEATHER, trailing_weather, with_row_index
from meterloom.operators.scale import standardise
from meterloom.sources.holidays import with_holiday_flag

KEYS = ("series_id",)
DAY_AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "count": F.count, "std": F.stddev_samp}


def day_base(panel: DataFrame, keys: Sequence[str] = KEYS, load: str = "total") -> DataFrame:
    """Mean temperature, peak load and summed radiation per day."""
    return panel.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.avg("temperature").alias("temperature"), F.max(load).alias("load_max"), F.sum("radiation").alias("radiation_sum")
    )


def last_known(column: str, ts: str = "ts") -> Column:
    """Latest non-null value by stamp; independent of row order."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ts)))


def day_last(panel: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return panel.groupBy(*keys, F.to_date("ts").alias("date")).agg(*[last_known(c).alias(c) for c in columns])


def densify_days(days: DataFrame, sums: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the absent days between a series' first and last day; sums are 0 there, all else null."""
    span = days.groupBy(*keys).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("date"))
    return grid.join(days, [*keys, "date"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in sums})


def day_aggregate(panel: DataFrame, column: str, how: str = "mean", keys: Sequence[str] = KEYS, dense: bool = True) -> DataFrame:
    """Daily series of one column under a named aggregate."""
    if how not in DAY_AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}; choose one of {sorted(DAY_AGGREGATES)}")
    days = panel.groupBy(*keys, F.to_date("ts").alias("date")).agg(DAY_AGGREGATES[how](column).alias(column))
    return densify_days(days, [column] if how in ("sum", "count") else [], keys) if dense else days


def temperature_load_days(panel: DataFrame, keys: Sequence[str] = KEYS, temperature: str = "temperature", load: str = "total") -> DataFrame:
    """Daily mean temperature and summed load with the weekday label."""
    days = panel.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.avg(temperature).alias("temperature"), F.sum(load).alias("load")
    )
    return densify_days(days, ["load"], keys).withColumn("weekday", weekday_label("date"))


def trend_line(days: DataFrame, x: str = "temperature", y: str = "load", keys: Sequence[str] = KEYS) -> DataFrame:
    """Least-squares slope and intercept over the rows where both values exist."""
    return days.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_min"),
        F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("x_max"),
    )


def with_calendar(days: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Day of year, month, weekday, weekend and holiday flags."""
    parts = days.withColumns(
        {
            "dayofyear": F.dayofyear("date"),
            "month": F.month("date"),
            "weekday": F.weekday("date"),
            "is_weekend": (F.weekday("date") >= 5).cast("int"),
        }
    )
    return with_holiday_flag(parts, holidays)


CLIMATE = ["temperature", "radiation_sum"]
TRAILING = list(TRAILING_WEATHER)


def feature_columns(trailing: bool) -> list[str]:
    return CLIMATE + (TRAILING if trailing else []) + ["is_weekend", "is_holiday"] + CYCLIC_COLUMNS


def day_features(
    panel: DataFrame,
    trailing: bool = False,
    keys: Sequence[str] = KEYS,
    load: str = "total",
    holidays: DataFrame | None = None,
    fit: Column | None = None,
    scale: bool = True,
    dense: bool = True,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Feature table per day: climate, optional trailing weather, calendar flags and cyclic terms.

    ``fit`` restricts the rows the scaler learns from (for example those before the test start); by default all.
    ``extra`` adds further day aggregates, such as the peak of another load column.
    """
    aggs = [
        F.avg("temperature").alias("temperature"),
        F.max(load).alias("load_max"),
        F.sum("radiation").alias("radiation_sum"),
    ]
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    if trailing:
        rows = panel if "rn" in panel.columns else with_row_index(panel, keys)
        rows = trailing_weather(rows, keys)
        aggs += [last_known(c).alias(c) for c in TRAILING]
    else:
        rows = panel
    days = rows.groupBy(*keys, F.to_date("ts").alias("date")).agg(*aggs)
    if dense:
        days = densify_days(days, ["radiation_sum"], keys)
    days = days.withColumn("temperature", round_half_even("temperature", 2))
    days = with_cyclic(with_calendar(days, holidays))
    climate = CLIMATE + (TRAILING if trailing else [])
    if scale:
        days = standardise(days, climate, keys, fit)
    return days.select(*keys, "date", "load_max", *(extra or {}), *feature_columns(trailing))
