"""Sources, sinks, projections, filters and reshaping over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.registry import register
from meterloom.functions import encode, timeaxis as ta
from meterloom.operators import daily, folds, ranking, reshape
from meterloom.operators.scale import min_max
from meterloom.session import scratch_path
from meterloom.sources import artefacts, panels

TEST_START = "2024-01-24"


def panel(spark, sf):
    return panels.indexed_events_panel(spark, sf)


def variants(spark, sf):
    return reshape.as_variants(panel(spark, sf), keep=("series_id", "ts", "rn", "ordinal"))


def scaled(spark, sf):
    return min_max(variants(spark, sf), keys=("series_id", "variant"))


def labels_det(days):
    """Labels that need no fitted model; ``cluster2`` is a second labelling."""
    return days.select(
        "series_id",
        "date",
        F.when(F.weekday("date") >= 5, 0).when(F.weekday("date") == 4, 1).otherwise(2).alias("cluster"),
        (F.day("date") % 3).alias("cluster2"),
    )


def day_labels(spark, sf):
    return labels_det(panels.events_panel(spark, sf).select("series_id", F.to_date("ts").alias("date")).distinct())


# ---- sources and sinks -------------------------------------------------------------------------------------------


@register("a1_series_csv", "series_id ts:t temperature:6 radiation:6 total:6 total_filter:6",
          "SELECT series_id, ts, temperature, radiation, total, total_filter FROM panel")
def a1(spark, sf):
    path = scratch_path(spark, "series-csv")
    text = F.concat(ta.stamp_text("ts"), F.lit("+00:00")).alias("Date")
    panel(spark, sf).select("series_id", text, *panels.MEASURES).write.option("header", True).csv(path)
    return panels.read_series_csv(spark, path, by_series=True)


@register("a2_label_artefacts", "series date:d cluster:i",
          "SELECT series_id AS series, CASE WHEN day(date) % 10 = 0 THEN NULL ELSE date END AS date, cluster FROM labels_det")
def a2(spark, sf):
    path = scratch_path(spark, "labels-csv")
    odd = F.when(F.day("date") % 10 == 0, F.lit("not a date")).otherwise(F.col("date").cast("string"))
    day_labels(spark, sf).select(odd.alias("DateOnly"), "cluster", F.col("series_id").alias("series")).write.option("header", True).csv(path)
    return artefacts.read_labels_csv(spark, path, ["cluster"], ["series"])


def det_profiles(spark, sf):
    from meterloom.operators.clustering import attach_labels, mean_profiles

    slots = reshape.day_slots(scaled(spark, sf).filter("variant = 'raw'"), "scaled")
    return mean_profiles(attach_labels(slots, day_labels(spark, sf).drop("cluster2")), ["series_id"])


@register("a3_mean_profiles", "series_id cluster:i slot:i value:6", "SELECT series_id, cluster, slot, value FROM profiles")
def a3(spark, sf):
    path = artefacts.write_keyed(det_profiles(spark, sf).withColumn("k", F.lit(3)), scratch_path(spark, "profiles"), ["k"])
    return artefacts.read_keyed(spark, path, k=3)


def _params(spark, sf):
    """A leaderboard per order priority: parameter text built from the table."""
    o = panels.orders_panel(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("orders"))
    return o.select(
        F.col("series_id").alias("model"),
        F.create_map(F.lit("days"), F.col("days").cast("string"), F.lit("orders"), F.col("orders").cast("string")).alias("best_params"),
    )


@register("a4_leaderboard_params", "model days:i orders:i",
          "SELECT series_id AS model, count(*) AS days, sum(n) AS orders FROM orders_days GROUP BY 1")
def a4(spark, sf):
    path = artefacts.write_leaderboard(_params(spark, sf), scratch_path(spark, "leaderboard"))
    board = artefacts.read_leaderboard(spark, path)
    return board.select("model", F.col("best_params")["days"].alias("days"), F.col("best_params")["orders"].alias("orders"))


@register("a5_keyed_artefacts", "variant series_id rows:i value:4",
          "SELECT variant, series_id, count(*) AS rows, sum(scaled) AS value FROM scaled GROUP BY 1, 2")
def a5(spark, sf):
    path = artefacts.write_keyed(scaled(spark, sf), scratch_path(spark, "keyed"), ["variant"])
    back = artefacts.read_keyed(spark, path)
    return back.groupBy("variant", "series_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("scaled").alias("value"))


@register("a6_results_json", "model params",
          """SELECT series_id AS model, '{"days":"' || count(*) || '","orders":"' || CAST(sum(n) AS BIGINT) || '"}' AS params FROM orders_days GROUP BY 1""")
def a6(spark, sf):
    path = artefacts.write_leaderboard(_params(spark, sf), scratch_path(spark, "results"))
    return spark.read.parquet(path).select("model", F.col("best_params").alias("params"))


@register("a7_forecast_tables", "model series_id rows:i total:4",
          "SELECT 'Last Day' AS model, series_id, count(*) AS rows, sum(last_day) AS total FROM lagged GROUP BY 2 "
          "UNION ALL SELECT 'Last Week', series_id, count(*), sum(last_week) FROM lagged GROUP BY 2")
def a7(spark, sf):
    from meterloom.plans.persistence import persistence_forecasts

    path = artefacts.write_table(persistence_forecasts(panel(spark, sf)), scratch_path(spark, "forecasts"), ["model"])
    return spark.read.parquet(path).groupBy("model", "series_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("predicted").alias("total"))


@register("a8_missing_inputs", "series_id k:i config_id:i variant status",
          """SELECT s.series_id, k.k, c.c AS config_id, v.v AS variant,
                    CASE WHEN k.k = 3 AND s.series_id < 'p' THEN 'run' ELSE 'missing' END AS status
             FROM (SELECT DISTINCT series_id FROM load15) s, (VALUES (2), (3)) k(k), (VALUES (1), (2), (3), (4)) c(c), (VALUES ('raw'), ('filter')) v(v)""")
def a8(spark, sf):
    series = panels.events_panel(spark, sf)
    expected = ranking.run_settings(series, [2, 3], [1, 2, 3, 4], ["raw", "filter"])
    have = series.filter("series_id < 'p'").select("series_id", F.lit(3).alias("k")).distinct()
    keys = ["series_id", "k"]
    return ranking.missing_settings(expected, have, keys).withColumn("status", F.lit("missing")).unionByName(
        ranking.runnable_settings(expected, have, keys).withColumn("status", F.lit("run")))


# ---- projections, filters, time ----------------------------------------------------------------------------------


@register("b1_load_variants", "series_id ts:t variant value:6", "SELECT series_id, ts, variant, value FROM variants")
def b1(spark, sf):
    return variants(spark, sf)


@register("b2_min_max_scaling", "series_id ts:t variant scaled:6", "SELECT series_id, ts, variant, scaled FROM scaled")
def b2(spark, sf):
    return scaled(spark, sf)


@register("b3_date_and_slot", "series_id ts:t date:d slot:i", "SELECT series_id, ts, date, slot FROM panel")
def b3(spark, sf):
    return panels.events_panel(spark, sf).withColumns({"date": ta.date_of("ts"), "slot": ta.slot_of("ts")})


@register("b4_zone_dropped", "series_id ts:t total:6", "SELECT series_id, ts, total FROM load15")
def b4(spark, sf):
    zoned = panels.events_panel(spark, sf).withColumn("zoned", F.col("ts").cast("timestamp"))
    return zoned.select("series_id", ta.drop_zone("zoned").alias("ts"), "total")


@register("b5_date_split", "series_id role rows:i total:4",
          "SELECT series_id, CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'train' ELSE 'test' END AS role, count(*) AS rows, sum(total) AS total FROM load15 GROUP BY 1, 2")
def b5(spark, sf):
    start = F.lit(TEST_START).cast("timestamp_ntz")
    split = panels.events_panel(spark, sf).withColumn("role", F.when(F.col("ts") < start, "train").otherwise("test"))
    return split.groupBy("series_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"))


@register("b6_fold_date_range", "series_id fold:i ts:t actual:6",
          """WITH d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT DISTINCT series_id, date FROM panel)),
                  f AS (SELECT series_id, k.k AS fold, min(date) AS lo, max(date) AS hi FROM d, (VALUES (1), (2)) k(k)
                        WHERE i >= n - (3 - k.k) * (n // 3) AND i < n - (2 - k.k) * (n // 3) GROUP BY 1, 2)
             SELECT p.series_id, f.fold, p.ts, p.total AS actual FROM panel p JOIN f ON p.series_id = f.series_id AND p.date BETWEEN f.lo AND f.hi""")
def b6(spark, sf):
    p = panels.events_panel(spark, sf).withColumn("date", F.to_date("ts"))
    days = folds.with_day_index(p.select("series_id", "date").distinct())
    tests = folds.expanding_roles(days, 2).filter("role = 'test'").groupBy("series_id", "fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return p.join(tests, "series_id").filter(F.col("date").between(F.col("lo"), F.col("hi"))).withColumnRenamed("total", "actual")


@register("b7_lenient_stamps", "event_id:i ts:t",
          "SELECT event_id, ts FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events WHERE event_id % 7 <> 0)")
def b7(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(ta.stamp_text("ts"))
    return ev.select("event_id", ta.lenient_stamp(text).alias("ts")).dropna(subset=["ts"])


def lagged(spark, sf):
    from meterloom.plans.persistence import with_persistence

    return with_persistence(panel(spark, sf))


@register("b8_valid_pairs", "series_id valid:i total:i sum_actual:4",
          "SELECT series_id, count(last_day) AS valid, count(*) AS total, sum(CASE WHEN last_day IS NOT NULL THEN total END) AS sum_actual FROM lagged GROUP BY 1")
def b8(spark, sf):
    both = F.col("total").isNotNull() & F.col("last_day").isNotNull()
    return lagged(spark, sf).groupBy("series_id").agg(
        F.count_if(both).alias("valid"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(both, F.col("total"))).alias("sum_actual")
    ).withColumnRenamed("rows", "total")


@register("b9_empty_days_dropped", "series_id date:d slot:i value:6",
          """SELECT series_id, date, slot, CASE WHEN day(date) % 5 = 0 OR slot % 4 = 0 THEN NULL ELSE total END AS value FROM panel
             WHERE (series_id, date) IN (SELECT (series_id, date) FROM panel WHERE day(date) % 5 <> 0 AND slot % 4 <> 0)""")
def b9(spark, sf):
    slots = reshape.day_slots(panels.events_panel(spark, sf), "total")
    holed = slots.withColumn("value", F.when((F.day("date") % 5 != 0) & (F.col("slot") % 4 != 0), F.col("value")))
    return reshape.drop_empty_days(holed)


@register("b11_rounded_temperature", "series_id date:d temperature:2", "SELECT series_id, date, round_even(round(temperature, 9), 2) AS temperature FROM days")
def b11(spark, sf):
    return daily.day_base(panels.events_panel(spark, sf)).withColumn("temperature", ta.round_half_even("temperature", 2))


@register("b12_weekend_flag", "series_id date:d is_weekend:i", "SELECT series_id, date, CAST(isodow(date) >= 6 AS INT) AS is_weekend FROM orders_days")
def b12(spark, sf):
    return panels.orders_panel(spark, sf).withColumn("is_weekend", ta.weekend_flag("date"))


@register("b13_calendar_parts", "series_id date:d dayofyear:i month:i weekday:i",
          "SELECT series_id, date, dayofyear(date) AS dayofyear, month(date) AS month, isodow(date) - 1 AS weekday FROM orders_days")
def b13(spark, sf):
    return panels.orders_panel(spark, sf).withColumns({"dayofyear": ta.day_of_year("date"), "month": F.month("date"), "weekday": ta.weekday("date")})


@register("b14_weekday_label", "weekday n:i", "SELECT strftime(date, '%a') AS weekday, sum(n) AS n FROM orders_days GROUP BY 1")
def b14(spark, sf):
    return panels.orders_panel(spark, sf).groupBy(ta.weekday_label("date").alias("weekday")).agg(F.sum("n").alias("n"))


@register("b15_week_position", "series_id ts:t week:i week_year:i minute_of_week:i",
          "SELECT series_id, ts, weekofyear(ts) AS week, isoyear(ts) AS week_year, (isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS minute_of_week FROM load15")
def b15(spark, sf):
    return panels.events_panel(spark, sf).withColumns(
        {"week": ta.iso_week("ts"), "week_year": ta.iso_week_year("ts"), "minute_of_week": ta.minute_of_week("ts")})


@register("b16_masked_percentage_error", "series_id mape:6 used:i",
          """SELECT series_id, avg(CASE WHEN abs(temperature) > 1e-10 THEN abs((temperature - radiation) / temperature) END) * 100 AS mape,
                    count(CASE WHEN abs(temperature) > 1e-10 THEN 1 END) AS used FROM load15 GROUP BY 1""")
def b16(spark, sf):
    from meterloom.operators.metrics import NEAR_ZERO, masked_mape

    a, p = F.col("temperature"), F.col("radiation")
    return panels.events_panel(spark, sf).groupBy("series_id").agg(masked_mape(a, p).alias("mape"), F.count_if(F.abs(a) > NEAR_ZERO).alias("used"))


@register("b17_target_columns", "series_id ts:t target value:6",
          "SELECT series_id, ts, 'total' AS target, total AS value FROM panel UNION ALL SELECT series_id, ts, 'total_filter', total_filter FROM panel")
def b17(spark, sf):
    p = panel(spark, sf).select("series_id", "ts", "temperature", "radiation", "total", "total_filter")
    return reshape.as_targets(p, exclude=["temperature", "radiation"])


@register("b18_one_day", "series_id ts:t total:6",
          "SELECT p.series_id, p.ts, p.total FROM panel p JOIN (SELECT series_id, min(date) AS d FROM panel GROUP BY 1) f ON f.series_id = p.series_id AND f.d = p.date")
def b18(spark, sf):
    from meterloom.plans.reports import day_slice

    return day_slice(panels.events_panel(spark, sf))


@register("b18_available_range", "series_id first_date:d last_date:d",
          "SELECT series_id, min(date) AS first_date, max(date) AS last_date FROM panel GROUP BY 1")
def b18b(spark, sf):
    from meterloom.plans.reports import available_range

    return available_range(panels.events_panel(spark, sf))


# ---- reshape -----------------------------------------------------------------------------------------------------


@register("c1_day_slot_pivot", "series_id date:d s0:6 s31:6 s95:6 filled:i",
          """SELECT series_id, date, max(CASE WHEN slot = 0 THEN total END) AS s0, max(CASE WHEN slot = 31 THEN total END) AS s31,
                    max(CASE WHEN slot = 95 THEN total END) AS s95, count(total) AS filled FROM panel GROUP BY 1, 2""")
def c1(spark, sf):
    wide = reshape.pivot_slots(reshape.day_slots(panels.events_panel(spark, sf), "total"))
    cells = [F.when(F.col(f"s{s}").isNotNull(), 1).otherwise(0) for s in range(96)]
    return wide.withColumn("filled", sum(cells[1:], cells[0]))


@register("c1_duplicate_slots", "series_id date:d slot:i readings:i",
          "SELECT event_type AS series_id, CAST(ts AS DATE) AS date, (hour(ts) * 60 + minute(ts)) // 15 AS slot, count(*) AS readings FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def c1d(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", "value")
    return reshape.duplicate_slots(reshape.day_slots(ev))


@register("c2_day_position_pivot", "series_id date:d " + " ".join(f"s{i}:6" for i in range(96)),
          "SELECT series_id, date, " + ", ".join(f"max(CASE WHEN ordinal = {i} THEN total END) AS s{i}" for i in range(96)) + " FROM panel GROUP BY 1, 2")
def c2(spark, sf):
    return reshape.pivot_slots(reshape.day_ordinals(panels.events_panel(spark, sf), "total"), n_slots=None)


@register("c3_wide_to_long", "series_id date:d slot:i value:6", "SELECT series_id, date, slot, total AS value FROM panel")
def c3(spark, sf):
    wide = reshape.pivot_slots(reshape.day_slots(panels.events_panel(spark, sf), "total"))
    return reshape.melt_slots(wide).dropna(subset=["value"])


@register("c4_recombined_stamp", "series_id ts:t value:6 time", "SELECT series_id, ts, total AS value, strftime(ts, '%H:%M:%S') AS time FROM load15")
def c4(spark, sf):
    return reshape.with_stamp(reshape.day_slots(panels.events_panel(spark, sf), "total")).withColumn("time", ta.time_text("slot"))


@register("c5_profile_vectors", "series_id date:d dims:i total:4",
          "SELECT series_id, date, 96 AS dims, sum(total) AS total FROM panel GROUP BY 1, 2")
def c5(spark, sf):
    vec = reshape.with_vector(reshape.profile_arrays(reshape.pivot_slots(reshape.day_slots(panels.events_panel(spark, sf), "total"))))
    from pyspark.ml.functions import vector_to_array

    a = vector_to_array("features")
    return vec.select("series_id", "date", F.size(a).alias("dims"), F.aggregate(a, F.lit(0.0), lambda s, v: s + v).alias("total"))
