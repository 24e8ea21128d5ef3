"""Plot-ready tables: the data behind each figure, without drawing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from meterloom.functions.timeaxis import iso_week, iso_week_year, minute_of_week
from meterloom.operators import clustering, daily, metrics, reshape, validity
from meterloom.operators.rowframe import running_share, with_row_index
from meterloom.session import materialise

KEYS = ("series_id",)


def available_range(panel: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return panel.groupBy(*keys).agg(F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"))


def day_slice(panel: DataFrame, day: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of one day; without ``day`` the first day of each series. A given day is a plain range filter on ``ts``."""
    if day is not None:
        start = F.lit(day).cast("date")
        return panel.filter((F.col("ts") >= start.cast("timestamp_ntz")) & (F.col("ts") < F.date_add(start, 1).cast("timestamp_ntz")))
    first = panel.groupBy(*keys).agg(F.min(F.to_date("ts")).alias("_first"))
    return panel.join(first, list(keys)).filter(F.to_date("ts") == F.col("_first")).drop("_first")


def residual_histogram(pairs: DataFrame, keys: Sequence[str] = KEYS, bins: int = 30) -> DataFrame:
    """Equal-width histogram of the residuals; the last bin includes its right edge."""
    res = pairs.withColumn("residual", F.col("actual") - F.col("predicted")).dropna(subset=["residual"])
    span = res.groupBy(*keys).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    binned = res.join(span, list(keys)).withColumn(
        "bin", F.least(F.coalesce(F.floor((F.col("residual") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(0)), F.lit(bins - 1)).cast("int")
    )
    counted = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("left_edge"), (F.col("lo") + width * (F.col("bin") + 1)).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def residuals_by_index(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = pairs if "rn" in pairs.columns else with_row_index(pairs, keys)
    return rows.select(*keys, F.col("rn").alias("index"), "predicted", (F.col("actual") - F.col("predicted")).alias("residual"))


def identity_envelope(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Smallest and largest of actual and predicted, the ends of the identity line."""
    return pairs.groupBy(*keys).agg(
        F.least(F.min("actual"), F.min("predicted")).alias("lo"), F.greatest(F.max("actual"), F.max("predicted")).alias("hi")
    )


def overlay(panel: DataFrame, forecasts: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = KEYS, smooth: bool = True) -> DataFrame:
    """Actual load, optionally the smoothed load, and any number of named forecasts as one long table."""
    lines = [("actual", panel.select(*keys, "ts", F.col("total").alias("value")))]
    if smooth:
        lines.append(("filtered", panel.select(*keys, "ts", F.col("total_filter").alias("value"))))
    lines += [(name, f.select(*keys, "ts", F.col("predicted").alias("value"))) for name, f in forecasts]
    out = None
    for name, df in lines:
        part = df.withColumn("line", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def cluster_members(slots: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, position: str = "slot") -> DataFrame:
    """Every day's line in its cluster with the cluster mean and the weekend flag."""
    labelled = slots.join(labels, [*keys, "date"])
    mean = labelled.groupBy(*keys, "cluster", position).agg(F.avg("value").alias("cluster_mean"))
    return labelled.join(mean, [*keys, "cluster", position]).withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))


def validity_curves(vectors: DataFrame, ks: Sequence[int] = tuple(range(2, 10)), keys: Sequence[str] = KEYS, restarts: int = clustering.RESTARTS) -> DataFrame:
    """Inertia and validity indices for every k (elbow and index curves)."""
    labels = clustering.cluster_days(vectors, ks, keys, restarts).drop("inertia")
    labelled = materialise(labels.join(vectors, [*keys, "date"]), "labelled")
    return validity.validity_table(labelled, [*keys, "k"])


def report_dataset(
    panel: DataFrame, targets: Sequence[str], ks: Sequence[int], slots_per_day: int = 96, restarts: int = clustering.RESTARTS
) -> tuple[DataFrame, DataFrame]:
    """Per target and k: cluster profiles with member counts, and the validity curves. Works for any sampling frequency
    by position within the day."""
    keys = ["series_id", "target"]
    long = reshape.as_targets(panel, targets)
    slots = reshape.drop_empty_days(reshape.day_ordinals(long, "value", keys), keys)
    vectors = reshape.profile_arrays(reshape.pivot_slots(slots, keys, slots_per_day), keys, slots_per_day)
    labels = clustering.cluster_days(vectors, ks, keys, restarts).drop("inertia")
    labelled = materialise(labels.join(vectors, [*keys, "date"]), "labelled")
    labels = labelled.drop("vec")
    profiles = clustering.mean_profiles(slots.join(labels, [*keys, "date"]), [*keys, "k"])
    counts = clustering.cluster_sizes(labels, [*keys, "k"])
    return profiles.join(counts, [*keys, "k", "cluster"]), validity.validity_table(labelled, [*keys, "k"])


def agreement_matrix(labels: DataFrame, names: Sequence, measure: str, keys: Sequence[str] = KEYS, by: str = "config_id") -> DataFrame:
    """Square matrix of one agreement measure: a row per labelling, a column per labelling."""
    long = validity.label_agreement(labels, names, keys, by)
    return long.groupBy(*keys, "left").pivot("right", list(names)).agg(F.max(measure))


def weekly_overlay(panel: DataFrame, value: str = "total", by_year: bool = False) -> DataFrame:
    """One line per ISO week over the minutes of the week. Weeks of different years overlay unless ``by_year``."""
    cols = ["series_id", iso_week("ts").alias("week")] + ([iso_week_year("ts").alias("week_year")] if by_year else [])
    return panel.select(*cols, minute_of_week("ts").alias("minute_of_week"), "ts", F.col(value).alias("value"))


def over_time(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Several variables over time in long form."""
    return reshape.as_targets(panel, columns)


def temperature_load_scatter(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily points with weekday and the 100-point trend line per series."""
    days = daily.temperature_load_days(panel)
    trend = daily.trend_line(days)
    x = F.col("x_min") + (F.col("x_max") - F.col("x_min")) * F.col("i") / F.lit(99.0)
    line = trend.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(
        "series_id", "i", x.alias("x"), (F.col("slope") * x + F.col("intercept")).alias("y")
    )
    return days, line


def day_profile(panel: DataFrame, day: str | None = None, value: str = "total") -> DataFrame:
    """One day with its cumulative share."""
    one = day_slice(panel, day).withColumn("date", F.to_date("ts"))
    return running_share(one, value)


def feature_surface(days: DataFrame, model, x1: str, x2: str, points: int = 50) -> DataFrame:
    """Model values on a grid spanned by two features. The grid has ``points`` squared rows per call."""
    ends = days.agg(F.min(x1).alias("a0"), F.max(x1).alias("a1"), F.min(x2).alias("b0"), F.max(x2).alias("b1"))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    at = lambda lo, hi, i: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(i) / F.lit(float(points - 1))
    grid = ends.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return model.transform(grid.select(at("a0", "a1", "i").alias(x1), at("b0", "b1", "j").alias(x2)))


def metric_bars(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """MAE, RMSE and R2 as bar heights."""
    d = metrics.full_diagnostics(pairs, keys)
    return d.select(*keys, "mae", "rmse", "r2").unpivot(list(keys), ["mae", "rmse", "r2"], "metric", "value")
