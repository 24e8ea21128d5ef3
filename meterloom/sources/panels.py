"""Readers for the raw series and the panels built from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from meterloom.functions.encode import nan_to_null
from meterloom.functions.timeaxis import drop_zone, floor_to_slot
from meterloom.operators.rowframe import smooth_three, with_row_index

SERIES_CSV_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.TimestampType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("radiation", T.DoubleType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("total_filter", T.DoubleType()),
    ]
)
MEASURES = ["temperature", "radiation", "total", "total_filter"]


def read_series_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = tuple(MEASURES),
    series_id: str | None = None,
    by_series: bool = False,
) -> DataFrame:
    """Metered series from CSV: explicit schema, named columns only, NaN as null, zone dropped.

    ``by_series`` expects a leading ``series_id`` column; otherwise the whole file is the one series ``series_id``.
    """
    schema = T.StructType(([T.StructField("series_id", T.StringType())] if by_series else []) + SERIES_CSV_SCHEMA.fields)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    key = F.col("series_id") if by_series else F.lit(series_id or "series")
    utc = F.to_utc_timestamp("Date", F.current_timezone())
    out = raw.select(key.alias("series_id"), drop_zone(utc).alias("ts"), *columns)
    return nan_to_null(out, list(columns))


def read_series_parquet(spark: SparkSession, path: str, columns: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    return nan_to_null(spark.read.parquet(path).select("series_id", "ts", *columns), list(columns))


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute panel over the event table: one series per event type."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value", "props")
    return ev.groupBy(F.col("event_type").alias("series_id"), floor_to_slot("ts").alias("ts")).agg(
        F.sum("value").alias("total"),
        F.avg(F.get_json_object("props", "$.k").cast("double")).alias("temperature"),
        F.count(F.lit(1)).cast("double").alias("radiation"),
    )


def indexed_events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event panel with its row position and the smoothed load."""
    return smooth_three(with_row_index(events_panel(spark, sf_dir)))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel over the order table: one series per order priority."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n")
    )


def full_grid(panel: DataFrame, slots: int = 96) -> DataFrame:
    """Densify to every slot of every day between a series' first and last day; missing values are null."""
    minutes = 1440 // slots
    span = panel.groupBy("series_id").agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    grid = span.select("series_id", F.explode(F.sequence("lo", "hi")).alias("d")).select(
        "series_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(slots - 1)),
                lambda s: F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), s * minutes, F.lit(0)),
            )
        ).alias("ts"),
    )
    return grid.join(panel, ["series_id", "ts"], "left")
