"""Min-max and standard scaling with statistics kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def min_max(df: DataFrame, value: str = "value", keys: Sequence[str] = ("series_id",), target: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) over the whole series.

    The statistics come from a partly aggregated group-by, one row per series, and are joined back without a hint: the
    planner broadcasts them while they are below the session's threshold and splits skewed partitions beyond it.
    """
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(stats, list(keys)).withColumn(target, (F.col(value) - F.col("_lo")) / span).drop("_lo", "_hi")


def standard_stats(df: DataFrame, columns: Sequence[str], keys: Sequence[str], fit: Column | None = None) -> DataFrame:
    """Mean and population deviation of each column over the rows where ``fit`` holds."""
    pick = (lambda c: F.when(fit, F.col(c))) if fit is not None else F.col
    aggs = []
    for c in columns:
        aggs += [F.avg(pick(c)).alias(f"{c}_mean"), F.stddev_pop(pick(c)).alias(f"{c}_sd")]
    return df.groupBy(*keys).agg(*aggs)


def standardise(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id",), fit: Column | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = standard_stats(df, columns, keys, fit)
    scaled = {
        c: F.when(F.col(f"{c}_sd") == 0, F.col(c) - F.col(f"{c}_mean")).otherwise(
            (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0))
        )
        for c in columns
    }
    return df.join(stats, list(keys)).withColumns(scaled).drop(*[f"{c}_{s}" for c in columns for s in ("mean", "sd")])
