"""Plot-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.clusters import ARI_MATRIX, NMI_MATRIX, labellings
from meterloom.catalog.features import det_vectors, pairs
from meterloom.catalog.forecasts import hard_forecast, hard_pairs
from meterloom.catalog.models import _HELD
from meterloom.catalog.registry import register
from meterloom.catalog.tables import day_labels, panel, scaled
from meterloom.operators import reshape
from meterloom.plans import reports
from meterloom.sources import panels


@register("l1_residual_histogram", "series_id bin:i n:i",
          f"""WITH r AS (SELECT series_id, a - p AS r FROM {_HELD}), m AS (SELECT series_id, min(r) AS lo, max(r) AS hi FROM r GROUP BY 1),
                   b AS (SELECT r.series_id, least(CAST(floor((r - lo) / ((hi - lo) / 30)) AS INT), 29) AS bin, count(*) AS n FROM r JOIN m USING (series_id) GROUP BY 1, 2)
              SELECT m.series_id, g.g AS bin, coalesce(b.n, 0) AS n FROM m CROSS JOIN generate_series(0, 29) g(g) LEFT JOIN b ON b.series_id = m.series_id AND b.bin = g.g""")
def l1(spark, sf):
    return reports.residual_histogram(pairs(spark, sf))


@register("l2_residuals_by_index", "series_id index:i predicted:6 residual:6",
          "SELECT series_id, rn AS index, last_day AS predicted, total - last_day AS residual FROM holdout WHERE last_day IS NOT NULL")
def l2(spark, sf):
    return reports.residuals_by_index(pairs(spark, sf).dropna(subset=["predicted"]))


@register("l3_actual_predicted_pairs", "series_id ts:t actual:6 predicted:6 lo:6 hi:6",
          """SELECT h.series_id, h.ts, h.actual, h.predicted, e.lo, e.hi FROM hard_pairs h
             JOIN (SELECT series_id, least(min(actual), min(predicted)) AS lo, greatest(max(actual), max(predicted)) AS hi FROM hard_pairs GROUP BY 1) e USING (series_id)""")
def l3(spark, sf):
    p = hard_pairs(spark, sf)
    return p.join(reports.identity_envelope(p), "series_id")


@register("l4_forecast_overlay", "series_id ts:t line value:6",
          """SELECT series_id, ts, 'actual' AS line, total AS value FROM panel UNION ALL SELECT series_id, ts, 'filtered', total_filter FROM panel
             UNION ALL SELECT series_id, ts, 'hybrid', predicted FROM hard_forecast UNION ALL SELECT series_id, ts, 'last day', last_day FROM holdout WHERE last_day IS NOT NULL""")
def l4(spark, sf):
    return reports.overlay(panel(spark, sf), [("hybrid", hard_forecast(spark, sf)), ("last day", pairs(spark, sf).dropna(subset=["predicted"]))])


@register("l5_cluster_members", "series_id date:d cluster:i slot:i value:6 cluster_mean:6 is_weekend:i",
          """SELECT s.series_id, s.date, l.cluster, s.slot, s.scaled AS value, p.value AS cluster_mean, CAST(isodow(s.date) >= 6 AS INT) AS is_weekend
             FROM scaled s JOIN labels_det l USING (series_id, date) JOIN profiles p ON p.series_id = s.series_id AND p.cluster = l.cluster AND p.slot = s.slot WHERE s.variant = 'raw'""")
def l5(spark, sf):
    slots = reshape.day_slots(scaled(spark, sf).filter("variant = 'raw'"), "scaled")
    return reports.cluster_members(slots, day_labels(spark, sf).drop("cluster2"))


@register("l5_interval_members", "series_id date:d cluster:i ival:i value:6 cluster_mean:6 is_weekend:i",
          """SELECT v.series_id, v.date, v.cluster, CAST(substr(v.ival, 2) AS INT) AS ival, v.value, c.c AS cluster_mean, CAST(isodow(v.date) >= 6 AS INT) AS is_weekend
             FROM lvec1 v JOIN cent1 c USING (series_id, cluster, ival)""")
def l5_intervals(spark, sf):
    long = det_vectors(spark, sf).select("series_id", "date", F.posexplode("vec").alias("pos", "value")).withColumn("ival", F.col("pos") + 1)
    return reports.cluster_members(long, day_labels(spark, sf).drop("cluster2"), position="ival")


@register("l6_validity_curves", "series_id target k:i inertia:6 silhouette:6 davies_bouldin:6 calinski_harabasz:6")
def l6(spark, sf):
    p = panel(spark, sf).select("series_id", "ts", "total", "temperature")
    return reports.report_dataset(p, ["total", "temperature"], range(2, 10))[1]


@register("l7_hourly_report_profiles", "series_id target k:i cluster:i slot:i value:6 days:i")
def l7(spark, sf):
    hourly = panels.events_panel(spark, sf).groupBy("series_id", F.window(F.col("ts"), "1 hour").start.cast("timestamp_ntz").alias("ts")).agg(F.sum("total").alias("total"))
    return reports.report_dataset(hourly, ["total"], range(2, 10), slots_per_day=24)[0]


@register("l8_rand_matrix", "series_id lft:i c1:6 c2:6 c3:6", ARI_MATRIX)
def l8(spark, sf):
    m = reports.agreement_matrix(labellings(spark, sf), [1, 2, 3], "ari")
    return m.withColumnsRenamed({"left": "lft", "1": "c1", "2": "c2", "3": "c3"})


@register("l8_mutual_information_matrix", "series_id lft:i c1:6 c2:6 c3:6", NMI_MATRIX)
def l8_nmi(spark, sf):
    m = reports.agreement_matrix(labellings(spark, sf), [1, 2, 3], "nmi")
    return m.withColumnsRenamed({"left": "lft", "1": "c1", "2": "c2", "3": "c3"})


@register("l9_weekly_overlay", "series_id week:i minute_of_week:i ts:t value:6",
          "SELECT series_id, weekofyear(ts) AS week, (isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS minute_of_week, ts, total AS value FROM load15")
def l9(spark, sf):
    return reports.weekly_overlay(panels.events_panel(spark, sf)).orderBy("series_id", "week", "minute_of_week")


@register("l10_variables_over_time", "series_id ts:t target value:6",
          """SELECT series_id, ts, 'total' AS target, total AS value FROM load15 UNION ALL SELECT series_id, ts, 'temperature', temperature FROM load15
             UNION ALL SELECT series_id, ts, 'radiation', radiation FROM load15""")
def l10(spark, sf):
    return reports.over_time(panels.events_panel(spark, sf), ["total", "temperature", "radiation"])


@register("l11_daily_aggregate", "series_id date:d total:2", "SELECT series_id, date, total FROM orders_dense")
def l11(spark, sf):
    from meterloom.operators.daily import day_aggregate

    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("total"))
    return day_aggregate(o, "total", "sum")


@register("l12_trend_line_points", "series_id i:i x:6 y:4",
          """SELECT series_id, g.g AS i, lo + (hi - lo) * g.g / 99.0 AS x, b0 + b1 * (lo + (hi - lo) * g.g / 99.0) AS y FROM (
               SELECT series_id, min(temperature) AS lo, max(temperature) AS hi, regr_slope(total_sum, temperature) AS b1, regr_intercept(total_sum, temperature) AS b0 FROM days GROUP BY 1)
             CROSS JOIN generate_series(0, 99) g(g)""")
def l12(spark, sf):
    return reports.temperature_load_scatter(panels.events_panel(spark, sf))[1]


@register("l12_scatter_points", "series_id date:d temperature:6 load:6 weekday",
          "SELECT series_id, date, temperature, total_sum AS load, strftime(date, '%a') AS weekday FROM days")
def l12_points(spark, sf):
    return reports.temperature_load_scatter(panels.events_panel(spark, sf))[0]


@register("l13_day_profile", "series_id ts:t total:6 share:6",
          """SELECT series_id, ts, total, sum(total) OVER (PARTITION BY series_id ORDER BY ts) / sum(total) OVER (PARTITION BY series_id) AS share FROM panel WHERE date = DATE '2024-01-10'""")
def l13(spark, sf):
    return reports.day_profile(panels.events_panel(spark, sf), "2024-01-10").withColumnRenamed("total_cumsum_normalized", "share")


_SURFACE = """WITH g AS (SELECT avg(radiation_sum) AS mx, avg(temperature) AS mz, avg(load_max) AS my, min(radiation_sum) AS x0, max(radiation_sum) AS x1, min(temperature) AS z0, max(temperature) AS z1,
   covar_pop(radiation_sum, radiation_sum) AS xx, covar_pop(temperature, temperature) AS zz, covar_pop(radiation_sum, temperature) AS xz,
   covar_pop(radiation_sum, load_max) AS xy, covar_pop(temperature, load_max) AS zy FROM days),
 b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM g),
 p AS (SELECT x0 + (x1 - x0) * i.i / 49.0 AS x, z0 + (z1 - z0) * j.j / 49.0 AS z, b.* FROM b, generate_series(0, 49) i(i), generate_series(0, 49) j(j))
 SELECT x AS radiation_sum, z AS temperature, my + b1 * (x - mx) + b2 * (z - mz) AS prediction FROM p"""


@register("l14_model_surface", "radiation_sum:6 temperature:6 prediction:4", _SURFACE)
def l14(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from meterloom.operators.daily import day_base

    days = day_base(panels.events_panel(spark, sf)).dropna()
    model = Pipeline(stages=[VectorAssembler(inputCols=["radiation_sum", "temperature"], outputCol="features"), LinearRegression(labelCol="load_max")]).fit(days)
    return reports.feature_surface(days, model, "radiation_sum", "temperature")


@register("l15_measure_bars", "series_id metric value:6",
          f"""WITH d AS (SELECT series_id, avg(abs(a - p)) AS mae, sqrt(avg((a - p) * (a - p))) AS rmse, 1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)) AS r2 FROM {_HELD} GROUP BY 1)
              SELECT series_id, 'mae' AS metric, mae AS value FROM d UNION ALL SELECT series_id, 'rmse', rmse FROM d UNION ALL SELECT series_id, 'r2', r2 FROM d""")
def l15(spark, sf):
    return reports.metric_bars(pairs(spark, sf))
