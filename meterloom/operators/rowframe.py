"""Row-exact window frames that do not put a whole series into one task.

Trailing windows, lags and running indices count *rows*. Partitioning such a window by ``series_id`` alone would send a
long series to a single task. Here the position of a row in its series is built from per-day counts (one small row per
series and day), and frames run inside fixed-size blocks of consecutive positions. The rows that a frame needs from the
neighbouring block are copied into it and dropped afterwards, so each result is the one a single global window gives.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ("series_id",)


def day_counts(panel: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Rows per series and day with the number of rows before that day and in the whole series.

    The window runs over one row per calendar day, so its partitions are bounded by the calendar.
    """
    days = panel.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("day_rows"))
    before = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(
        *keys,
        "date",
        "day_rows",
        F.coalesce(F.sum("day_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("day_rows").over(Window.partitionBy(*keys)).alias("series_rows"),
    )


def with_ordinal(panel: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row inside its day. ``ties`` orders rows that share a stamp."""
    in_day = Window.partitionBy(*keys, "date").orderBy(ts, *ties)
    return panel.withColumn("date", F.to_date(ts)).withColumn("ordinal", F.row_number().over(in_day) - 1)


def with_row_index(panel: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """Add ``date``, ``ordinal``, ``rn`` (0-based position in the series) and ``series_rows``."""
    counts = day_counts(panel, keys, ts).drop("day_rows")
    rows = with_ordinal(panel, keys, ts, ties)
    return rows.join(counts, [*keys, "date"]).withColumn("rn", F.col("rows_before") + F.col("ordinal")).drop("rows_before")


def with_frames(
    df: DataFrame,
    frames: Mapping[str, tuple[Column, int, int]],
    keys: Sequence[str] = KEYS,
    index: str = "rn",
    block_rows: int | None = None,
) -> DataFrame:
    """Evaluate ``{name: (aggregate, first, last)}`` over rows ``index+first .. index+last``.

    All frames share one shuffle. ``index`` must be a gap-free position as given by :func:`with_row_index`.
    """
    back = max(0, -min(lo for _, lo, _ in frames.values()))
    ahead = max(0, max(hi for _, _, hi in frames.values()))
    size = block_rows or max(4096, 8 * (back + ahead))
    if size < back or size < ahead:
        raise ValueError("a block must hold at least one frame")
    pos = F.col(index) % F.lit(size)
    home = F.floor(F.col(index) / F.lit(size))
    targets = [home]
    if back:
        targets.append(F.when(pos >= size - back, home + 1))
    if ahead:
        targets.append(F.when((pos < ahead) & (home > 0), home - 1))
    copied = df.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    base = Window.partitionBy(*keys, "_block").orderBy(index)
    framed = copied.withColumns({n: a.over(base.rowsBetween(lo, hi)) for n, (a, lo, hi) in frames.items()})
    return framed.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def lag_frame(column: str, rows: int) -> tuple[Column, int, int]:
    """The value ``rows`` positions earlier, as a one-row frame."""
    return F.max(column), -rows, -rows


# Trailing weather windows (name -> column, aggregate, rows) on a 15-minute grid.
TRAILING_WEATHER = {
    "temp_ma_24h": ("temperature", "avg", 96),
    "temp_ma_48h": ("temperature", "avg", 192),
    "temp_ma_72h": ("temperature", "avg", 288),
    "radiation_sum_24h": ("radiation", "sum", 96),
    "radiation_sum_48h": ("radiation", "sum", 192),
}


def trailing_weather(df: DataFrame, keys: Sequence[str] = KEYS, names: Sequence[str] | None = None) -> DataFrame:
    """Trailing means and sums that accept a partly filled frame at the start of a series."""
    wanted = names or list(TRAILING_WEATHER)
    frames = {}
    for n in wanted:
        c, fn, rows = TRAILING_WEATHER[n]
        frames[n] = ((F.avg if fn == "avg" else F.sum)(c), -(rows - 1), 0)
    return with_frames(df, frames, keys)


def smooth_three(df: DataFrame, source: str = "total", target: str = "total_filter", keys: Sequence[str] = KEYS) -> DataFrame:
    """Centred three-row mean."""
    return with_frames(df, {target: (F.avg(source), -1, 1)}, keys)


def running_share(df: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cumulative value inside the day as a share of the day's total."""
    day = Window.partitionBy(*keys, "date")
    upto = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(day)
    return df.withColumns(
        {
            f"{value}_cumsum": F.sum(value).over(upto),
            f"{value}_cumsum_normalized": F.sum(value).over(upto) / F.nullif(total, F.lit(0.0)),
        }
    )


def carry_forward(df: DataFrame, value: str, target: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill nulls with the latest earlier value (edge padding of a short forecast).

    Two levels: inside the day by a window, across days by the last known value of each earlier day.
    """
    day_last = df.groupBy(*keys, "date").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    carried = day_last.select(*keys, "date", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, "date"], "left")
        .withColumn(target, F.coalesce("_inside", "_carried"))
        .drop("_inside", "_carried")
    )
