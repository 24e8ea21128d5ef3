"""Stage tables between steps: partitioned Parquet keyed by setting, JSON-encoded parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterloom.functions.encode import params_from_json, params_to_json
from meterloom.functions.timeaxis import lenient_date

SETTING = ["variant", "k", "config_id"]


def write_keyed(df: DataFrame, path: str, keys: Sequence[str] = tuple(SETTING), replace_only_present: bool = True) -> str:
    """Write a stage table with its setting as partition columns.

    Rows are rebalanced by ``keys``: partitions get a sensible size, small ones are joined, and a setting or series that holds
    most of the rows is split over several tasks. Only the settings present in ``df`` are replaced.
    """
    keys = [k for k in keys if k in df.columns]
    writer = df.hint("rebalance", *[F.col(c) for c in keys]).write.mode("overwrite").partitionBy(*keys)
    if replace_only_present:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def read_keyed(spark: SparkSession, path: str, **setting) -> DataFrame:
    """Read a stage table; a setting given by name prunes partitions."""
    df = spark.read.parquet(path)
    for name, value in setting.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def write_leaderboard(results: DataFrame, path: str, params: str = "best_params") -> str:
    """Parameters are stored as JSON text."""
    results.withColumn(params, params_to_json(params)).write.mode("overwrite").parquet(path)
    return path


def read_leaderboard(spark: SparkSession, path: str, params: str = "best_params") -> DataFrame:
    return spark.read.parquet(path).withColumn(params, params_from_json(params))


def read_leaderboard_csv(spark: SparkSession, path: str, schema: str, params: str = "Best Params") -> DataFrame:
    """Leaderboards exchanged as CSV with quoted JSON."""
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
        .withColumn(params, params_from_json(F.col(f"`{params}`")))
    )


def read_labels_csv(spark: SparkSession, path: str, columns: Sequence[str], text_columns: Sequence[str] = ()) -> DataFrame:
    """Per-day cluster table from CSV. The index column may be called ``DateOnly`` or anything else if it comes first;
    unreadable dates become null. ``columns`` are numbers, ``cluster`` an integer; ``text_columns`` stay text."""
    text = spark.read.option("header", True).csv(path)
    index = "DateOnly" if "DateOnly" in text.columns else text.columns[0]
    numbers = [F.col(c).cast("double").cast("int" if c == "cluster" else "double").alias(c) for c in columns]
    return text.select(lenient_date(F.col(f"`{index}`")).alias("date"), *numbers, *[F.col(c) for c in text_columns])


def write_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> str:
    """Forecasts, measures and summaries; with ``keys`` every model pair keeps its own partition."""
    w = df.write.mode("overwrite")
    if keys:
        w = w.partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)
    return path
