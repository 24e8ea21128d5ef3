"""Long and wide day profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.ml.functions import array_to_vector

from meterloom.functions.timeaxis import SLOTS_PER_DAY, slot_of, stamp_from
from meterloom.operators.rowframe import with_ordinal

KEYS = ("series_id",)


def as_variants(panel: DataFrame, keep: Sequence[str] = ("series_id", "ts"), raw: str = "total", smooth: str = "total_filter") -> DataFrame:
    """Raw and smoothed load as rows of one table, so that both run in the same job."""
    return panel.unpivot(list(keep), [raw, smooth], "variant", "value").withColumn(
        "variant", F.when(F.col("variant") == raw, F.lit("raw")).otherwise(F.lit("filter"))
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]


def as_targets(panel: DataFrame, targets: Sequence[str] | None = None, exclude: Sequence[str] = (), keep: Sequence[str] = ("series_id", "ts")) -> DataFrame:
    """Every chosen numeric column as rows named by ``target``; by default all numeric columns but ``exclude``."""
    chosen = list(targets) if targets else [c for c in numeric_columns(panel) if c not in exclude]
    casted = panel.select(*keep, *[F.col(c).cast("double").alias(c) for c in chosen])
    return casted.unpivot(list(keep), chosen, "target", "value")


def day_slots(panel: DataFrame, value: str = "value", keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Long day x slot table keyed by time of day."""
    return panel.select(*keys, F.to_date(ts).alias("date"), slot_of(ts).alias("slot"), F.col(value).alias("value"))


def day_ordinals(panel: DataFrame, value: str = "value", keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Long day x position table for any sampling frequency."""
    return with_ordinal(panel, keys, ts).select(*keys, "date", F.col("ordinal").alias("slot"), F.col(value).alias("value"))


def duplicate_slots(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Day and slot pairs that hold more than one reading; a pivot over them would be ambiguous."""
    return slots.groupBy(*keys, "date", "slot").agg(F.count(F.lit(1)).alias("readings")).filter("readings > 1")


def drop_empty_days(slots: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the days with at least one value."""
    filled = slots.groupBy(*keys, "date").agg(F.count("value").alias("filled")).filter("filled > 0").drop("filled")
    return slots.join(filled, [*keys, "date"], "left_semi")


def pivot_slots(slots: DataFrame, keys: Sequence[str] = KEYS, n_slots: int | None = SLOTS_PER_DAY, strict: bool = True) -> DataFrame:
    """Wide day profile with columns ``s0 .. s{n-1}``.

    A given number of slots spends no job on finding it; a reading outside them fails the query. ``None`` takes as many columns as
    the longest day has positions, at least a day's quarter hours. With ``strict`` a repeated slot fails too. The checks
    are a filter, which stays whichever columns are read.
    """
    if n_slots is None:
        n_slots = max(SLOTS_PER_DAY, (slots.agg(F.max("slot")).first()[0] or 0) + 1)  # one number
    cells = [F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"s{s}") for s in range(n_slots)]
    fail = lambda text: F.raise_error(F.lit(text)).cast("boolean")
    outside = (F.col("_last") >= n_slots) | (F.col("_first") < 0)
    ends = [F.min("slot").alias("_first"), F.max("slot").alias("_last")]
    sound = F.when(outside, fail(f"a reading lies outside the {n_slots} slots of a day"))
    if not strict:
        return slots.groupBy(*keys, "date").agg(*cells, *ends).filter(sound.otherwise(F.lit(True))).drop("_first", "_last")
    # The slots seen are kept as bits, 64 to a word; more readings than bits means that some slot came twice.
    words = range((n_slots + 63) // 64)
    seen = [F.bit_or(F.when(F.floor(F.col("slot") / 64) == w, F.expr("shiftleft(1L, cast(slot % 64 as int))"))).alias(f"_w{w}") for w in words]
    days = slots.groupBy(*keys, "date").agg(*cells, *seen, *ends, F.count("slot").alias("_readings"))
    distinct = sum((F.coalesce(F.bit_count(F.col(f"_w{w}")), F.lit(0)) for w in words), F.lit(0))
    sound = sound.when(F.col("_readings") > distinct, fail("two readings for one day and slot")).otherwise(F.lit(True))
    return days.filter(sound).drop("_readings", "_first", "_last", *[f"_w{w}" for w in words])


def melt_slots(wide: DataFrame, keys: Sequence[str] = KEYS, n_slots: int = SLOTS_PER_DAY, value: str = "value") -> DataFrame:
    """Back to long form; the slot number is read off the column name."""
    return wide.unpivot([*keys, "date"], [f"s{s}" for s in range(n_slots)], "slot", value).withColumn(
        "slot", F.substring("slot", 2, 9).cast("int")
    )


def with_stamp(slots: DataFrame, minutes: int = 15) -> DataFrame:
    return slots.withColumn("ts", stamp_from("date", "slot", minutes))


def profile_arrays(wide: DataFrame, keys: Sequence[str] = KEYS, n_slots: int = SLOTS_PER_DAY, fill: float = 0.0) -> DataFrame:
    """One array per day in slot order, missing slots filled."""
    return wide.select(*keys, "date", F.array(*[F.coalesce(F.col(f"s{s}"), F.lit(fill)) for s in range(n_slots)]).alias("vec"))


def with_vector(df: DataFrame, source: str = "vec", target: str = "features") -> DataFrame:
    return df.withColumn(target, array_to_vector(F.col(source)))
