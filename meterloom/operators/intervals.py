"""Interval catalogues and per-day interval means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterloom.functions.timeaxis import SLOT_MINUTES, minute_of_day

# The four interval catalogues, as start and end times of each interval I1, I2, ...
CATALOGUES = {
    1: [
        ("01:00", "06:00"), ("06:00", "08:00"), ("08:00", "12:00"), ("12:00", "15:00"),
        ("15:00", "18:00"), ("18:00", "21:30"), ("21:00", "01:00"),
    ],
    2: [
        ("01:00", "06:00"), ("06:00", "07:00"), ("07:00", "08:00"), ("08:00", "09:00"), ("09:00", "10:00"), ("10:00", "12:00"), ("12:00", "15:00"),
        ("15:00", "18:00"), ("18:00", "21:30"), ("21:00", "01:00"),
    ],
    3: [
        ("01:00", "06:00"), ("06:00", "08:00"), ("08:00", "10:00"), ("10:00", "12:00"), ("12:00", "15:00"),
        ("15:00", "18:00"), ("18:00", "21:30"), ("21:00", "01:00"),
    ],
    4: [
        ("01:00", "06:00"), ("06:00", "08:00"), ("08:00", "12:00"), ("12:00", "14:00"), ("14:00", "15:00"),
        ("15:00", "18:00"), ("18:00", "21:30"), ("21:00", "01:00"),
    ],
}


def _minutes(text: str) -> int:
    hours, minutes = text.split(":")
    return int(hours) * 60 + int(minutes)


def interval_rows(configs: Sequence[int] | None = None) -> list[tuple[int, str, int, int]]:
    """(config_id, ival, start minute, end minute) of the chosen catalogues."""
    out = []
    for config in configs or list(CATALOGUES):
        for i, (start, end) in enumerate(CATALOGUES[config], 1):
            out.append((config, f"I{i}", _minutes(start), _minutes(end)))
    return out


def interval_table(spark: SparkSession, configs: Sequence[int] | None = None) -> DataFrame:
    return spark.createDataFrame(
        interval_rows(configs), "config_id int, ival string, start_min int, end_min int"
    )


def inside(minute: Column, start: int | Column, end: int | Column) -> Column:
    """Both ends belong to the interval; one whose start is not before its end wraps inside the same day."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.when(start < end, (minute >= start) & (minute <= end)).otherwise((minute >= start) | (minute <= end))


def interval_bridge(spark: SparkSession, configs: Sequence[int] | None = None, slot_minutes: int = SLOT_MINUTES) -> DataFrame:
    """(config_id, ival, slot): a slot may belong to several intervals, so this is many-to-many."""
    slots = F.filter(
        F.sequence(F.lit(0), F.lit(1440 // slot_minutes - 1)),
        lambda s: inside(s * slot_minutes, F.col("start_min"), F.col("end_min")),
    )
    return interval_table(spark, configs).select("config_id", "ival", F.explode(slots).alias("slot"))


def interval_columns(configs: Sequence[int] | None = None) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for config, name, _, _ in interval_rows(configs):
        out.setdefault(config, []).append(f"c{config}_{name}")
    return out


def interval_means_wide(
    panel: DataFrame,
    value: str = "value",
    keys: Sequence[str] = ("series_id",),
    configs: Sequence[int] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """All interval means of a day in one aggregation.

    Membership is a condition inside each average, so readings are not multiplied by the intervals they fall into and
    only one partly aggregated row per day reaches the shuffle. Days without any value are dropped.
    """
    minute = minute_of_day(ts)
    aggs = [
        F.avg(F.when(inside(minute, start, end), F.col(value))).alias(f"c{config}_{name}")
        for config, name, start, end in interval_rows(configs)
    ]
    days = panel.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs, F.count(value).alias("_filled"))
    return days.filter("_filled > 0").drop("_filled")


def interval_means_long(wide: DataFrame, keys: Sequence[str] = ("series_id",), configs: Sequence[int] | None = None) -> DataFrame:
    """Long form: one row per day, catalogue and interval."""
    parts = [
        F.struct(F.lit(config).alias("config_id"), F.lit(name).alias("ival"), F.col(f"c{config}_{name}").alias("value"))
        for config, name, _, _ in interval_rows(configs)
    ]
    return wide.select(*keys, "date", F.explode(F.array(*parts)).alias("p")).select(*keys, "date", "p.*")


def interval_vectors(
    wide: DataFrame, keys: Sequence[str] = ("series_id",), configs: Sequence[int] | None = None, fill: float | None = 0.0
) -> DataFrame:
    """One array of interval means per day and catalogue; missing means become ``fill`` as learners need numbers."""
    parts = []
    for config, columns in interval_columns(configs).items():
        cells = [F.coalesce(F.col(c), F.lit(fill)) if fill is not None else F.col(c) for c in columns]
        parts.append(F.struct(F.lit(config).alias("config_id"), F.array(*cells).alias("vec")))
    return wide.select(*keys, "date", F.explode(F.array(*parts)).alias("p")).select(*keys, "date", "p.*")
