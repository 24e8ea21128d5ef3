"""Interval means, day aggregates, row windows, joins, rankings and scalar encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.registry import register
from meterloom.catalog.tables import day_labels, lagged, panel, scaled
from meterloom.functions import encode, timeaxis as ta
from meterloom.operators import clustering, daily, folds, intervals, metrics, ranking, reshape, rowframe
from meterloom.operators.scale import standardise
from meterloom.sources import holidays, panels

VAR = ("series_id", "variant")


def imeans_wide(spark, sf):
    return intervals.interval_means_wide(scaled(spark, sf), "scaled", VAR)


def det_vectors(spark, sf):
    """Config 1 interval vectors of the raw load."""
    wide = intervals.interval_means_wide(scaled(spark, sf).filter("variant = 'raw'"), "scaled", configs=[1])
    return intervals.interval_vectors(wide, configs=[1]).drop("config_id")


# ---- intervals ---------------------------------------------------------------------------------------------------


@register("d1_interval_catalogue", "config_id:i ival start_min:i end_min:i readings:i",
          """SELECT i.config_id, i.ival, i.start_min, i.end_min, count(*) AS readings FROM panel s JOIN intervals i
             ON (CASE WHEN i.start_min < i.end_min THEN s.slot * 15 BETWEEN i.start_min AND i.end_min
                 ELSE s.slot * 15 >= i.start_min OR s.slot * 15 <= i.end_min END) GROUP BY ALL""")
def d1(spark, sf):
    per_slot = panels.events_panel(spark, sf).groupBy(ta.slot_of("ts").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    bridge = intervals.interval_bridge(spark).join(intervals.interval_table(spark), ["config_id", "ival"])
    return per_slot.join(F.broadcast(bridge), "slot").groupBy("config_id", "ival", "start_min", "end_min").agg(F.sum("n").alias("readings"))


@register("d2_interval_membership", "series_id ts:t config_id:i ival",
          """SELECT s.series_id, s.ts, i.config_id, i.ival FROM panel s JOIN intervals i
             ON (CASE WHEN i.start_min < i.end_min THEN s.slot * 15 BETWEEN i.start_min AND i.end_min
                 ELSE s.slot * 15 >= i.start_min OR s.slot * 15 <= i.end_min END)""")
def d2(spark, sf):
    rows = panels.events_panel(spark, sf).select("series_id", "ts", ta.slot_of("ts").alias("slot"))
    return rows.join(F.broadcast(intervals.interval_bridge(spark)), "slot")


@register("d3_interval_means", "series_id variant date:d config_id:i ival value:6",
          "SELECT series_id, variant, date, config_id, ival, value FROM imeans")
def d3(spark, sf):
    return intervals.interval_means_long(imeans_wide(spark, sf), VAR).dropna(subset=["value"])


@register("b10_missing_as_zero", "series_id date:d ival value:6", "SELECT series_id, date, ival, value FROM vec1")
def b10(spark, sf):
    v = det_vectors(spark, sf).select("series_id", "date", F.posexplode("vec").alias("pos", "value"))
    return v.withColumn("ival", F.concat(F.lit("I"), (F.col("pos") + 1).cast("string")))


# ---- aggregates --------------------------------------------------------------------------------------------------


@register("e1_day_aggregates", "series_id date:d temperature:6 load_max:6 radiation_sum:6",
          "SELECT series_id, date, temperature, load_max, radiation_sum FROM days")
def e1(spark, sf):
    return daily.day_base(panels.events_panel(spark, sf))


@register("e2_last_known_of_day", "series_id date:d temperature:6 total:6",
          """SELECT series_id, date, arg_max(temperature, ts) FILTER (WHERE ordinal % 3 <> 0) AS temperature, arg_max(total, ts) AS total
             FROM panel GROUP BY 1, 2""")
def e2(spark, sf):
    holed = rowframe.with_ordinal(panels.events_panel(spark, sf)).withColumn("temperature", F.when(F.col("ordinal") % 3 != 0, F.col("temperature")))
    return daily.day_last(holed, ["temperature", "total"])


@register("e3_dense_days", "series_id date:d total:2 n:i", "SELECT series_id, date, total, n FROM orders_dense")
def e3(spark, sf):
    return daily.densify_days(panels.orders_panel(spark, sf), ["total"]).withColumn("n", F.coalesce("n", F.lit(0)))


@register("e4_cluster_mean_profiles", "series_id cluster:i slot:i value:6", "SELECT series_id, cluster, slot, value FROM profiles")
def e4(spark, sf):
    from meterloom.catalog.tables import det_profiles

    return det_profiles(spark, sf)


@register("e5_days_per_cluster", "series_id cluster:i days:i",
          """SELECT s.series_id, k.k AS cluster, count(l.date) AS days FROM (SELECT DISTINCT series_id FROM days) s CROSS JOIN (VALUES (0), (1), (2), (3)) k(k)
             LEFT JOIN labels_det l ON l.series_id = s.series_id AND l.cluster = k.k GROUP BY 1, 2""")
def e5(spark, sf):
    return clustering.cluster_sizes(day_labels(spark, sf), ["series_id"], 4)


@register("e6_weekday_weekend_split", "series_id cluster:i days:i weekdays:i weekends:i weekend_share:6",
          """SELECT series_id, cluster2 AS cluster, count(*) AS days, count(*) FILTER (WHERE isodow(date) < 6) AS weekdays,
                    count(*) FILTER (WHERE isodow(date) >= 6) AS weekends, 100.0 * count(*) FILTER (WHERE isodow(date) >= 6) / count(*) AS weekend_share
             FROM labels_det GROUP BY 1, 2""")
def e6(spark, sf):
    return clustering.weekday_split(day_labels(spark, sf).select("series_id", "date", F.col("cluster2").alias("cluster")), ["series_id"])


@register("e7_interval_centroids", "series_id cluster:i ival value:6", "SELECT series_id, cluster, ival, c AS value FROM cent1")
def e7(spark, sf):
    c = clustering.centroids(det_vectors(spark, sf).join(day_labels(spark, sf), ["series_id", "date"]), ["series_id"])
    return c.select("series_id", "cluster", F.posexplode("centroid").alias("pos", "value")).withColumn("ival", F.concat(F.lit("I"), (F.col("pos") + 1).cast("string")))


@register("e8_chosen_day_aggregate", "series_id date:d how value:6",
          """SELECT series_id, date, h.how, CASE h.how WHEN 'mean' THEN total_mean WHEN 'sum' THEN total_sum ELSE load_max END AS value
             FROM days, (VALUES ('mean'), ('sum'), ('max')) h(how)""")
def e8(spark, sf):
    p = panels.events_panel(spark, sf)
    parts = [daily.day_aggregate(p, "total", how, dense=False).select("series_id", "date", F.lit(how).alias("how"), F.col("total").alias("value")) for how in ("mean", "sum", "max")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("e9_temperature_load_days", "series_id date:d temperature:6 load:6 weekday",
          "SELECT series_id, date, temperature, total_sum AS load, strftime(date, '%a') AS weekday FROM days")
def e9(spark, sf):
    return daily.temperature_load_days(panels.events_panel(spark, sf))


@register("e10_trend_line", "series_id slope:6 intercept:6",
          "SELECT series_id, regr_slope(total_sum, temperature) AS slope, regr_intercept(total_sum, temperature) AS intercept FROM days GROUP BY 1")
def e10(spark, sf):
    return daily.trend_line(daily.temperature_load_days(panels.events_panel(spark, sf)))


@register("e11_fold_mean_and_sample_deviation", "series_id model rmse_mean:6 rmse_std:6 wmape_mean:6 wmape_std:6",
          """WITH f AS (SELECT series_id, k.k AS fold, 'Last Day' AS model, total AS a, last_day AS p FROM lagged, (VALUES (1), (2)) k(k)
                        WHERE rn >= series_rows - (3 - k.k) * (series_rows // 3) AND rn < series_rows - (2 - k.k) * (series_rows // 3) AND last_day IS NOT NULL),
                  m AS (SELECT series_id, model, fold, sqrt(avg((a - p) * (a - p))) AS rmse, sum(abs(a - p)) / sum(abs(a)) * 100 AS wmape FROM f GROUP BY ALL)
             SELECT series_id, model, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(wmape) AS wmape_mean, stddev_samp(wmape) AS wmape_std FROM m GROUP BY 1, 2""")
def e11(spark, sf):
    tests = folds.expanding_roles(lagged(spark, sf), 2).filter("role = 'test'").withColumn("model", F.lit("Last Day"))
    scores = metrics.benchmark_metrics(tests, ["series_id", "model", "fold"], "total", "last_day")
    return metrics.cv_summary(scores, ["series_id", "model"], ["rmse", "wmape"])


@register("e12_fold_mean_and_population_deviation", "series_id accuracy:6 accuracy_std:6",
          """WITH f AS (SELECT series_id, date, day(date) % 4 AS fold, CASE WHEN cluster = cluster2 THEN 1.0 ELSE 0.0 END AS hit FROM labels_det),
                  m AS (SELECT series_id, fold, avg(hit) AS accuracy FROM f GROUP BY 1, 2)
             SELECT series_id, avg(accuracy) AS accuracy, stddev_pop(accuracy) AS accuracy_std FROM m GROUP BY 1""")
def e12(spark, sf):
    d = day_labels(spark, sf).withColumn("fold", F.day("date") % 4)
    return metrics.classification_leaderboard(metrics.classification_scores(d, ["series_id", "fold"], "cluster", "cluster2"), ["series_id"])


@register("e13_value_envelope", "series_id lo:6 hi:6",
          "SELECT series_id, least(min(total), min(last_day)) AS lo, greatest(max(total), max(last_day)) AS hi FROM holdout GROUP BY 1")
def e13(spark, sf):
    from meterloom.plans.reports import identity_envelope

    return identity_envelope(pairs(spark, sf))


def pairs(spark, sf):
    """Actual against the value one day of rows earlier, over the hold-out part."""
    held = lagged(spark, sf).filter(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))
    return held.select("series_id", "ts", "date", "rn", "series_rows", F.col("total").alias("actual"), F.col("last_day").alias("predicted"))


# ---- row windows -------------------------------------------------------------------------------------------------


@register("f1_trailing_temperature", "series_id ts:t temp_ma_24h:10 temp_ma_48h:10 temp_ma_72h:10",
          "SELECT series_id, ts, temp_ma_24h, temp_ma_48h, temp_ma_72h FROM trailing_rows")
def f1(spark, sf):
    return rowframe.trailing_weather(rowframe.with_row_index(panels.events_panel(spark, sf)), names=["temp_ma_24h", "temp_ma_48h", "temp_ma_72h"])


@register("f2_trailing_radiation", "series_id ts:t radiation_sum_24h:6 radiation_sum_48h:6",
          "SELECT series_id, ts, radiation_sum_24h, radiation_sum_48h FROM trailing_rows")
def f2(spark, sf):
    return rowframe.trailing_weather(rowframe.with_row_index(panels.events_panel(spark, sf)), names=["radiation_sum_24h", "radiation_sum_48h"])


@register("f1_trailing_over_gaps", "series_id ts:t mean96:10 sum96:6",
          """SELECT series_id, ts, avg(temperature) OVER w AS mean96, sum(radiation) OVER w AS sum96 FROM full15
             WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)""")
def f1_gaps(spark, sf):
    grid = rowframe.with_row_index(panels.full_grid(panels.events_panel(spark, sf)))
    return rowframe.with_frames(grid, {"mean96": (F.avg("temperature"), -95, 0), "sum96": (F.sum("radiation"), -95, 0)}, block_rows=500)


@register("f3_centred_smoothing", "series_id ts:t total_filter:6", "SELECT series_id, ts, total_filter FROM panel")
def f3(spark, sf):
    return panel(spark, sf)


@register("f4_last_day_lag", "series_id ts:t last_day:6", "SELECT series_id, ts, last_day FROM lagged WHERE last_day IS NOT NULL")
def f4(spark, sf):
    return lagged(spark, sf).dropna(subset=["last_day"])


@register("f5_last_week_lag", "series_id ts:t last_week:6", "SELECT series_id, ts, last_week FROM lagged WHERE last_week IS NOT NULL")
def f5(spark, sf):
    return lagged(spark, sf).dropna(subset=["last_week"])


@register("f6_position_in_day", "series_id ts:t ordinal:i", "SELECT series_id, ts, ordinal FROM panel")
def f6(spark, sf):
    return rowframe.with_ordinal(panels.events_panel(spark, sf))


@register("f7_position_in_series", "series_id ts:t rn:i series_rows:i", "SELECT series_id, ts, rn, series_rows FROM panel")
def f7(spark, sf):
    return rowframe.with_row_index(panels.events_panel(spark, sf))


@register("f8_cumulative_day_share", "series_id ts:t share:6",
          "SELECT series_id, ts, sum(total) OVER (PARTITION BY series_id, date ORDER BY ts) / sum(total) OVER (PARTITION BY series_id, date) AS share FROM panel")
def f8(spark, sf):
    p = panels.events_panel(spark, sf).withColumn("date", F.to_date("ts"))
    return rowframe.running_share(p, "total").withColumnRenamed("total_cumsum_normalized", "share")


@register("f9_edge_padding", "series_id ts:t padded:6",
          """SELECT series_id, ts, last_value(CASE WHEN date < DATE '2024-01-20' AND ordinal % 2 = 0 THEN total END IGNORE NULLS)
                    OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS padded FROM panel""")
def f9(spark, sf):
    p = rowframe.with_ordinal(panels.events_panel(spark, sf))
    short = p.withColumn("f", F.when((F.col("date") < F.lit("2024-01-20").cast("date")) & (F.col("ordinal") % 2 == 0), F.col("total")))
    return rowframe.carry_forward(short, "f", "padded")


@register("f10_expanding_history", "series_id date:d rows:i total:6 squares:4",
          """WITH d AS (SELECT series_id, date, count(*) AS n, sum(total) AS s, sum(total * total) AS q FROM panel GROUP BY 1, 2)
             SELECT series_id, date, coalesce(sum(n) OVER w, 0) AS rows, coalesce(sum(s) OVER w, 0) AS total, coalesce(sum(q) OVER w, 0) AS squares FROM d
             WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def f10(spark, sf):
    from meterloom.plans.walkforward import history_sums

    p = panels.events_panel(spark, sf)
    return history_sums(p, {"rows": F.lit(1.0), "total": F.col("total"), "squares": F.col("total") * F.col("total")})


# ---- joins, sets, sorts ------------------------------------------------------------------------------------------


@register("g1_labels_left_join", "series_id date:d load_max:6 cluster:i",
          "SELECT d.series_id, d.date, d.load_max, coalesce(l.cluster, -1) AS cluster FROM days d LEFT JOIN (SELECT * FROM labels_det WHERE cluster2 <> 0) l USING (series_id, date)")
def g1(spark, sf):
    days = daily.day_base(panels.events_panel(spark, sf))
    return days.join(day_labels(spark, sf).filter("cluster2 <> 0"), ["series_id", "date"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


@register("g2_actual_forecast_join", "series_id ts:t actual:6 predicted:6", "SELECT series_id, ts, actual, predicted FROM hard_pairs")
def g2(spark, sf):
    from meterloom.catalog.forecasts import hard_pairs

    return hard_pairs(spark, sf)


@register("g3_second_resolution_alignment", "series_id ts:t actual:6 predicted:6",
          """SELECT e.event_type AS series_id, date_trunc('second', e.ts) AS ts, e.value AS actual, f.value AS predicted
             FROM events e JOIN events f ON e.event_type = f.event_type AND date_trunc('second', e.ts) = date_trunc('second', f.ts)""")
def g3(spark, sf):
    from meterloom.plans.evaluation import align_by_second

    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("series_id"), "ts", "value")
    return align_by_second(ev.withColumnRenamed("value", "actual"), ev.withColumnRenamed("value", "predicted"))


@register("g4_regressors_on_stamp", "series_id ts:t total:6 temperature:6 radiation:6",
          """WITH s AS (SELECT series_id, avg(temperature) AS tm, stddev_pop(temperature) AS ts_, avg(radiation) AS rm, stddev_pop(radiation) AS rs FROM load15 GROUP BY 1)
             SELECT l.series_id, l.ts, l.total, (l.temperature - tm) / ts_ AS temperature, CASE WHEN rs = 0 THEN 0 ELSE (l.radiation - rm) / rs END AS radiation
             FROM load15 l JOIN s USING (series_id)""")
def g4(spark, sf):
    p = panels.events_panel(spark, sf)
    regressors = standardise(p.select("series_id", "ts", "temperature", "radiation"), ["temperature", "radiation"])
    return p.select("series_id", "ts", "total").join(regressors, ["series_id", "ts"], "left")


@register("g5_features_side_by_side", "series_id ts:t s1:6 c1:6 weekday:i is_weekend:i",
          """SELECT series_id, ts, sin(2 * pi() * rn / 96) AS s1, cos(2 * pi() * rn / 96) AS c1, isodow(ts) - 1 AS weekday, CAST(isodow(ts) >= 6 AS INT) AS is_weekend FROM panel""")
def g5(spark, sf):
    f = encode.fourier_terms("rn", 96, 1)
    rows = rowframe.with_row_index(panels.events_panel(spark, sf))
    return rows.withColumns({"s1": f["sin_96_1"], "c1": f["cos_96_1"], "weekday": ta.weekday("ts"), "is_weekend": ta.weekend_flag("ts")})


@register("g6_rows_appended", "series_id role rows:i total:4",
          "SELECT series_id, CASE WHEN date < DATE '2024-01-24' THEN 'train' ELSE 'test' END AS role, count(*) AS rows, sum(total) AS total FROM panel GROUP BY 1, 2")
def g6(spark, sf):
    p = folds.date_split(panels.events_panel(spark, sf).withColumn("date", F.to_date("ts")), "2024-01-24")
    both = p.filter("role = 'train'").unionByName(p.filter("role = 'test'"))
    return both.groupBy("series_id", "role").agg(F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"))


@register("g7_profile_lookup", "series_id date:d slot:i value:6",
          "SELECT p.series_id, p.date, f.slot, f.value FROM preds_det p JOIN profiles f ON f.series_id = p.series_id AND f.cluster = p.cluster")
def g7(spark, sf):
    from meterloom.catalog.forecasts import preds_det
    from meterloom.catalog.tables import det_profiles

    return preds_det(spark, sf).join(det_profiles(spark, sf), ["series_id", "cluster"])


@register("g8_run_settings", "series_id k:i config_id:i variant",
          "SELECT s.series_id, k.k, c.c AS config_id, v.v AS variant FROM (SELECT DISTINCT series_id FROM orders_days) s, (VALUES (2), (3)) k(k), (VALUES (1), (2), (3), (4)) c(c), (VALUES ('raw'), ('filter')) v(v)")
def g8(spark, sf):
    return ranking.run_settings(panels.orders_panel(spark, sf), [2, 3], [1, 2, 3, 4], ["raw", "filter"])


@register("g9_holiday_lookup", "series_id date:d is_holiday:i",
          "SELECT o.series_id, o.date, CAST(h.date IS NOT NULL AS INT) AS is_holiday FROM orders_days o LEFT JOIN (SELECT DISTINCT date FROM holidays) h ON h.date = o.date")
def g9(spark, sf):
    return holidays.with_holiday_flag(panels.orders_panel(spark, sf))


@register("g10_fold_complement", "series_id fold:i days:i total:2",
          """WITH d AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS m FROM orders_days)
             SELECT series_id, k.k AS fold, count(*) AS days, sum(total) AS total FROM d, (VALUES (1), (2), (3)) k(k)
             WHERE NOT (i >= m - (4 - k.k) * (m // 4) AND i < m - (3 - k.k) * (m // 4)) GROUP BY 1, 2""")
def g10(spark, sf):
    d = folds.complement_roles(folds.with_day_index(panels.orders_panel(spark, sf)), 3).filter("role = 'train'")
    return d.groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("days"), F.sum("total").alias("total"))


@register("g11_distinct_weeks", "series_id week:i", "SELECT DISTINCT series_id, weekofyear(date) AS week FROM orders_days")
def g11(spark, sf):
    return panels.orders_panel(spark, sf).select("series_id", ta.iso_week("date").alias("week")).distinct()


@register("g12_models_excluded", "model days:i", "SELECT series_id AS model, count(*) AS days FROM orders_days WHERE series_id NOT IN ('1-URGENT') GROUP BY 1")
def g12(spark, sf):
    board = panels.orders_panel(spark, sf).groupBy(F.col("series_id").alias("model")).agg(F.count(F.lit(1)).alias("days"))
    return ranking.without_models(board, ["1-URGENT"])


@register("g13_sorted_by_time", "series_id place:i date:d",
          "SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) AS place, date FROM days")
def g13(spark, sf):
    return folds.with_day_index(daily.day_base(panels.events_panel(spark, sf))).withColumn("place", F.col("rn") + 1).orderBy("series_id", "date")


def _boards(spark, sf):
    """Two competing forecasts per series, scored."""
    from meterloom.plans.persistence import persistence_backtest

    return persistence_backtest(panels.events_panel(spark, sf), "2024-01-24")


_BOARD_SQL = """SELECT series_id, model, sqrt(avg((total - p) * (total - p))) AS rmse FROM (
   SELECT series_id, 'Last Day' AS model, total, last_day AS p FROM holdout UNION ALL SELECT series_id, 'Last Week', total, last_week FROM holdout)
   WHERE p IS NOT NULL GROUP BY 1, 2"""


@register("g14_leaderboard_order", "series_id model rmse:6 place:i",
          f"SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY rmse ASC NULLS LAST, model) AS place FROM ({_BOARD_SQL})")
def g14(spark, sf):
    return ranking.leaderboard(_boards(spark, sf), "rmse", ["series_id"])


@register("g15_best_model", "series_id model rmse:6",
          f"SELECT series_id, model, rmse FROM ({_BOARD_SQL}) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY rmse ASC NULLS LAST, model) = 1")
def g15(spark, sf):
    return ranking.best_per_setting(_boards(spark, sf), "rmse", ["series_id"])


# ---- scalar functions --------------------------------------------------------------------------------------------


@register("h1_cyclic_encoding", "series_id date:d month_sin:6 month_cos:6 weekday_sin:6 weekday_cos:6 dayofyear_sin:6 dayofyear_cos:6",
          """SELECT series_id, date, sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
                    sin(2 * pi() * (isodow(date) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS weekday_cos,
                    sin(2 * pi() * dayofyear(date) / 365) AS dayofyear_sin, cos(2 * pi() * dayofyear(date) / 365) AS dayofyear_cos FROM orders_days""")
def h1(spark, sf):
    return encode.with_cyclic(daily.with_calendar(panels.orders_panel(spark, sf)))


_FOURIER = [(672, 10), (96, 5)]


@register("h2_fourier_terms", "series_id ts:t " + " ".join(f"{f}_{p}_{k}:6" for p, o in _FOURIER for k in range(1, o + 1) for f in ("sin", "cos")),
          "SELECT series_id, ts, " + ", ".join(f"{f}(2 * pi() * {k} * (rn % {p}) / {p}) AS {f}_{p}_{k}" for p, o in _FOURIER for k in range(1, o + 1) for f in ("sin", "cos")) + " FROM panel")
def h2(spark, sf):
    rows = rowframe.with_row_index(panels.events_panel(spark, sf))
    return rows.withColumns({**encode.fourier_terms("rn", 672, 10), **encode.fourier_terms("rn", 96, 5)})


@register("h3_error_functions", "series_id mae:6 mse:6 rmse:6",
          "SELECT series_id, avg(abs(total - last_day)) AS mae, avg((total - last_day) * (total - last_day)) AS mse, sqrt(avg((total - last_day) * (total - last_day))) AS rmse FROM holdout GROUP BY 1")
def h3(spark, sf):
    a, p = F.col("actual"), F.col("predicted")
    return pairs(spark, sf).groupBy("series_id").agg(metrics.mae(a, p).alias("mae"), metrics.mse(a, p).alias("mse"), metrics.rmse(a, p).alias("rmse"))


@register("h4_clipped_forecast", "series_id ts:t clipped:6", "SELECT series_id, ts, greatest(total - 30, 0) AS clipped FROM panel")
def h4(spark, sf):
    return panels.events_panel(spark, sf).select("series_id", "ts", encode.clip_at_zero(F.col("total") - 30).alias("clipped"))


@register("h5_stamp_text", "event_id:i text back:t",
          "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, date_trunc('second', ts) AS back FROM events")
def h5(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ta.stamp_text("ts").alias("text"))
    return ev.withColumn("back", ta.lenient_stamp("text"))


@register("h6_time_text_minutes", "series_id ts:t minutes:i", "SELECT series_id, ts, hour(ts) * 60 + minute(ts) AS minutes FROM load15")
def h6(spark, sf):
    p = panels.events_panel(spark, sf)
    return p.select("series_id", "ts", ta.minutes_from_text(F.date_format("ts", "HH:mm")).alias("minutes"))


@register("h7_json_parameters", "event_id:i k:i", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def h7(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    decoded = ev.withColumn("params", encode.params_from_json("props"))
    again = decoded.withColumn("params", encode.params_from_json(encode.params_to_json("params")))
    return again.select("event_id", F.col("params")["k"].alias("k"))


@register("h8_integer_label", "series_id date:d label:i", "SELECT series_id, date, cluster AS label FROM labels_det")
def h8(spark, sf):
    return day_labels(spark, sf).select("series_id", "date", encode.strict_label(F.col("cluster").cast("double")).alias("label"))
