"""Shared small pieces: reading a table, naming columns safely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_row(df: DataFrame):
    """All columns of ``df`` as one struct, so that columns an operator adds cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
