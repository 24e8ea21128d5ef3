"""Walk-forward engine, benchmark models and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.models import _BENCH
from meterloom.catalog.registry import register
from meterloom.catalog.tables import TEST_START, panel
from meterloom.operators import metrics
from meterloom.operators.rowframe import with_row_index
from meterloom.plans import benchmark, persistence, walkforward
from meterloom.session import materialise
from meterloom.sources import panels


@register("k30_walk_forward_history", "series_id date:d n:i sx:6 sy:4 sxx:4 sxy:4",
          """WITH d AS (SELECT series_id, date, count(*) AS n, sum(temperature) AS sx, sum(total) AS sy, sum(temperature * temperature) AS sxx, sum(temperature * total) AS sxy FROM panel GROUP BY 1, 2)
             SELECT series_id, date, coalesce(sum(n) OVER w, 0) AS n, coalesce(sum(sx) OVER w, 0) AS sx, coalesce(sum(sy) OVER w, 0) AS sy, coalesce(sum(sxx) OVER w, 0) AS sxx,
                    coalesce(sum(sxy) OVER w, 0) AS sxy FROM d WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def k30(spark, sf):
    x, y = F.col("temperature"), F.col("total")
    return walkforward.history_sums(panels.events_panel(spark, sf), {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y})


@register("k30_walk_forward_regression", "series_id ts:t fitted:5",
          """WITH d AS (SELECT series_id, date, count(*) AS n, sum(temperature) AS sx, sum(total) AS sy, sum(temperature * temperature) AS sxx, sum(temperature * total) AS sxy FROM panel GROUP BY 1, 2),
                  h AS (SELECT series_id, date, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM d
                        WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
                  b AS (SELECT series_id, date, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM h WHERE n IS NOT NULL)
             SELECT p.series_id, p.ts, b.a + b.b * p.temperature AS fitted FROM panel p JOIN b USING (series_id, date)""")
def k30_fit(spark, sf):
    rows = with_row_index(panels.events_panel(spark, sf))
    return walkforward.walk_forward_linear(rows, [F.lit(1.0), F.col("temperature")], penalty=0.0).dropna(subset=["fitted"])


def _forecasts(spark, sf, *models, value="total", splits=0):
    return benchmark.benchmark_forecasts(panel(spark, sf), TEST_START, value, models, splits)


_HOLD = "series_id model r2:6 mae:6 rmse:6 mape:4 wmape:6 valid_samples:i total_samples:i"


@register("k28_arma_weekly_harmonics", _HOLD + " place:i")
def k28(spark, sf):
    return benchmark.holdout_table(_forecasts(spark, sf, benchmark.ARMA_WEEKLY))


@register("k29_arma_weather_calendar", _HOLD + " place:i")
def k29(spark, sf):
    return benchmark.holdout_table(_forecasts(spark, sf, benchmark.ARMA_FULL))


@register("k31_additive_model", _HOLD + " place:i")
def k31(spark, sf):
    return benchmark.holdout_table(_forecasts(spark, sf, benchmark.ADDITIVE))


@register("k32_benchmark_table", _HOLD + " place:i")
def k32(spark, sf):
    models = tuple(benchmark.COLUMNS)
    return benchmark.holdout_table(_forecasts(spark, sf, *models), (*models, benchmark.ZERO_SHOT))


@register("k32_wide_predictions", "series_id ts:t Actual:6 Last_Day:6 Last_Week:6",
          "SELECT series_id, ts, total AS Actual, last_day AS Last_Day, last_week AS Last_Week FROM holdout")
def k32_wide(spark, sf):
    models = (benchmark.LAST_DAY, benchmark.LAST_WEEK)
    return benchmark.wide_predictions(_forecasts(spark, sf, *models), models)


@register("k33_persistence_cross_validation", "series_id model fold:i r2:6 mae:6 rmse:6 wmape:6 valid_samples:i",
          "SELECT series_id, split_part(model, '/', 1) AS model, CAST(split_part(model, '/', 2) AS INT) AS fold, r2, mae, rmse, wmape, valid_samples FROM ("
          + _BENCH.format(src="""(SELECT series_id, m || '/' || k.k AS model, total, p FROM (SELECT *, 'Last Day' AS m, last_day AS p FROM lagged UNION ALL SELECT *, 'Last Week', last_week FROM lagged) l, (VALUES (1), (2)) k(k)
             WHERE rn >= series_rows - (3 - k.k) * (series_rows // 3) AND rn < series_rows - (2 - k.k) * (series_rows // 3))""") + ")")
def k33(spark, sf):
    return benchmark.cv_details(_forecasts(spark, sf, benchmark.LAST_DAY, benchmark.LAST_WEEK, splits=2))


@register("k33_benchmark_cross_validation", "series_id model r2_mean:6 r2_std:6 mae_mean:6 mae_std:6 rmse_mean:6 rmse_std:6 wmape_mean:6 wmape_std:6")
def k33_all(spark, sf):
    return benchmark.cv_table(benchmark.cv_details(_forecasts(spark, sf, *benchmark.COLUMNS, splits=2)))
