"""Leaderboards, top-1 picks and run settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Sort direction of each leaderboard measure (True = ascending).
DIRECTIONS = {"accuracy": False, "mse": True, "wmape": True, "wmape_signed": True, "rmse": True, "wmape_mean": True}


def measure_order(measure: str, name: str = "model", ascending: bool | None = None) -> list[Column]:
    """Nulls last either way, ties by name."""
    up = DIRECTIONS.get(measure, True) if ascending is None else ascending
    first = F.asc_nulls_last(measure) if up else F.desc_nulls_last(measure)
    return [first, F.asc(name)]


def leaderboard(results: DataFrame, measure: str, keys: Sequence[str] = (), name: str = "model") -> DataFrame:
    """Rank the models of each setting. A setting has one row per model."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return results.withColumn("place", F.row_number().over(w.orderBy(*measure_order(measure, name))))


def best_per_setting(results: DataFrame, measure: str, keys: Sequence[str], name: str = "model") -> DataFrame:
    return leaderboard(results, measure, keys, name).filter("place = 1").drop("place")


def run_settings(series: DataFrame, ks: Sequence[int], configs: Sequence[int], variants: Sequence[str]) -> DataFrame:
    """Every combination of the chosen settings for each series."""
    grid = [F.struct(F.lit(k).alias("k"), F.lit(c).alias("config_id"), F.lit(v).alias("variant")) for k in ks for c in configs for v in variants]
    return series.select("series_id").distinct().withColumn("g", F.explode(F.array(*grid))).select("series_id", "g.*")


def model_pairs(classifiers: DataFrame, regressors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All classifier and regressor names of the same setting; both lists hold a fixed set of models."""
    return classifiers.join(regressors, list(keys))


def missing_settings(expected: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settings whose inputs are absent."""
    return expected.join(available.select(*keys).distinct(), list(keys), "left_anti")


def runnable_settings(expected: DataFrame, available: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(available.select(*keys).distinct(), list(keys), "left_semi")


def without_models(results: DataFrame, names: Sequence[str], name: str = "model") -> DataFrame:
    return results.filter(~F.col(name).isin(list(names)))
