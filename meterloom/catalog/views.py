"""SQL views used by the comparison queries; each mirrors a panel or feature table of the library."""

from __future__ import annotations

import re

from meterloom.operators.intervals import interval_rows

_INTERVALS = ", ".join(f"({c}, '{n}', {s}, {e})" for c, n, s, e in interval_rows())

_VIEWS: dict[str, str] = {
    "load15": """
SELECT event_type AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, sum(value) AS total,
       avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS temperature, CAST(count(*) AS DOUBLE) AS radiation
FROM events GROUP BY 1, 2""",
    "panel": """
SELECT *, CAST(ts AS DATE) AS date, (hour(ts) * 60 + minute(ts)) // 15 AS slot,
       row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn,
       count(*) OVER (PARTITION BY series_id) AS series_rows,
       row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts) - 1 AS ordinal,
       avg(total) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS total_filter
FROM load15""",
    "variants": """
SELECT series_id, ts, date, slot, rn, ordinal, 'raw' AS variant, total AS value FROM panel
UNION ALL SELECT series_id, ts, date, slot, rn, ordinal, 'filter' AS variant, total_filter AS value FROM panel""",
    "scaled": """
SELECT *, (value - min(value) OVER s) / nullif(max(value) OVER s - min(value) OVER s, 0) AS scaled
FROM variants WINDOW s AS (PARTITION BY series_id, variant)""",
    "full15": """
SELECT g.series_id, g.ts, l.total, l.temperature, l.radiation
FROM (SELECT series_id, unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP),
             CAST(max(CAST(ts AS DATE)) AS TIMESTAMP) + INTERVAL '23 hours 45 minutes', INTERVAL 15 MINUTE)) AS ts
      FROM load15 GROUP BY series_id) g LEFT JOIN load15 l USING (series_id, ts)""",
    "intervals": f"SELECT * FROM (VALUES {_INTERVALS}) AS v(config_id, ival, start_min, end_min)",
    "imeans": """
SELECT s.series_id, s.variant, s.date, i.config_id, i.ival AS ival, avg(s.scaled) AS value
FROM scaled s JOIN intervals i ON (CASE WHEN i.start_min < i.end_min
       THEN s.slot * 15 BETWEEN i.start_min AND i.end_min ELSE s.slot * 15 >= i.start_min OR s.slot * 15 <= i.end_min END)
GROUP BY ALL""",
    "days": """
SELECT series_id, date, avg(temperature) AS temperature, max(total) AS load_max, sum(radiation) AS radiation_sum,
       max(total_filter) AS filter_max, avg(total) AS total_mean, sum(total) AS total_sum
FROM panel GROUP BY 1, 2""",
    "orders_days": """
SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total, count(*) AS n
FROM orders GROUP BY 1, 2""",
    "orders_dense": """
SELECT g.series_id, CAST(g.date AS DATE) AS date, coalesce(o.total, 0) AS total, o.n AS n_raw, coalesce(o.n, 0) AS n
FROM (SELECT series_id, unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS date
      FROM orders_days GROUP BY series_id) g LEFT JOIN orders_days o ON o.series_id = g.series_id AND o.date = CAST(g.date AS DATE)""",
    "easter": """
SELECT y, make_date(y, p // 31, p % 31 + 1) AS sunday FROM (
 SELECT y, h + m - 7 * n + 114 AS p FROM (
  SELECT y, h, m, (a + 11 * h + 22 * m) // 451 AS n FROM (
   SELECT y, a, h, (32 + 2 * e + 2 * i - h - k) % 7 AS m FROM (
    SELECT y, a, b % 4 AS e, c // 4 AS i, c % 4 AS k, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM (
     SELECT CAST(y AS BIGINT) AS y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM generate_series(1990, 2030) AS t(y))))))""",
    "holidays": """
SELECT make_date(e.y, d.m, d.d) AS date FROM easter e,
 (VALUES (1,1),(1,6),(3,19),(5,1),(6,9),(8,15),(10,12),(11,1),(12,6),(12,8),(12,25)) AS d(m, d)
UNION ALL SELECT sunday - 3 FROM easter UNION ALL SELECT sunday - 2 FROM easter""",
    "trailing_rows": """
SELECT *, avg(temperature) OVER (w ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS temp_ma_24h,
  avg(temperature) OVER (w ROWS BETWEEN 191 PRECEDING AND CURRENT ROW) AS temp_ma_48h,
  avg(temperature) OVER (w ROWS BETWEEN 287 PRECEDING AND CURRENT ROW) AS temp_ma_72h,
  sum(radiation) OVER (w ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS radiation_sum_24h,
  sum(radiation) OVER (w ROWS BETWEEN 191 PRECEDING AND CURRENT ROW) AS radiation_sum_48h
FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ts)""",
    "raw_features": """
SELECT t.series_id, t.date, round_even(round(avg(temperature), 9), 2) AS temperature, max(total) AS load_max, sum(radiation) AS radiation_sum,
  arg_max(temp_ma_24h, ts) AS temp_ma_24h, arg_max(temp_ma_48h, ts) AS temp_ma_48h, arg_max(temp_ma_72h, ts) AS temp_ma_72h,
  arg_max(radiation_sum_24h, ts) AS radiation_sum_24h, arg_max(radiation_sum_48h, ts) AS radiation_sum_48h,
  CAST(isodow(t.date) >= 6 AS INT) AS is_weekend, CAST(max(h.date) IS NOT NULL AS INT) AS is_holiday,
  sin(2 * pi() * month(t.date) / 12) AS month_sin, cos(2 * pi() * month(t.date) / 12) AS month_cos,
  sin(2 * pi() * (isodow(t.date) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(t.date) - 1) / 7) AS weekday_cos,
  sin(2 * pi() * dayofyear(t.date) / 365) AS dayofyear_sin, cos(2 * pi() * dayofyear(t.date) / 365) AS dayofyear_cos
FROM trailing_rows t LEFT JOIN holidays h ON h.date = t.date GROUP BY t.series_id, t.date""",
    # Labels that need no fitted model: weekend, Friday, other days; and a second labelling by day number.
    "labels_det": """
SELECT series_id, date, CASE WHEN isodow(date) >= 6 THEN 0 WHEN isodow(date) = 5 THEN 1 ELSE 2 END AS cluster,
       day(date) % 3 AS cluster2
FROM days""",
    "vectors1": """
SELECT series_id, date, ival, value FROM imeans WHERE variant = 'raw' AND config_id = 1""",
    "vec1": """
SELECT g.series_id, g.date, i.ival AS ival, coalesce(v.value, 0.0) AS value
FROM (SELECT DISTINCT series_id, date FROM scaled WHERE scaled IS NOT NULL) g
CROSS JOIN (SELECT ival FROM intervals WHERE config_id = 1) i
LEFT JOIN vectors1 v ON v.series_id = g.series_id AND v.date = g.date AND v.ival = i.ival""",
    "lvec1": "SELECT v.*, l.cluster FROM vec1 v JOIN labels_det l USING (series_id, date)",
    "cent1": "SELECT series_id, cluster, ival, avg(value) AS c FROM lvec1 GROUP BY ALL",
    "own1": """
SELECT v.series_id, v.date, v.cluster, sum((v.value - c.c) * (v.value - c.c)) AS dist2
FROM lvec1 v JOIN cent1 c USING (series_id, cluster, ival) GROUP BY ALL""",
    # Forecast pairs that need no fitted model: the load 96 rows earlier.
    "lagged": """
SELECT *, lag(total, 96) OVER (PARTITION BY series_id ORDER BY ts) AS last_day,
       lag(total, 672) OVER (PARTITION BY series_id ORDER BY ts) AS last_week
FROM panel""",
    "holdout": "SELECT * FROM lagged WHERE ts >= TIMESTAMP '2024-01-24'",
    "profiles": """
SELECT s.series_id, l.cluster, s.slot, avg(s.scaled) AS value
FROM scaled s JOIN labels_det l USING (series_id, date) WHERE s.variant = 'raw' GROUP BY ALL""",
    # Predicted peak: the previous day's maximum. Predicted cluster: the label seven days earlier.
    "preds_det": """
SELECT d.series_id, d.date, p.load_max AS peak, w.cluster AS cluster
FROM days d JOIN days p ON p.series_id = d.series_id AND p.date = d.date - 1
JOIN labels_det w ON w.series_id = d.series_id AND w.date = d.date - 7""",
    "hard_forecast": """
SELECT p.series_id, CAST(p.date AS TIMESTAMP) + to_minutes(CAST(f.slot * 15 AS INT)) AS ts, f.value * p.peak AS predicted
FROM preds_det p JOIN profiles f ON f.series_id = p.series_id AND f.cluster = p.cluster""",
    "hard_pairs": """
SELECT h.series_id, h.ts, p.date, p.total AS actual, h.predicted FROM hard_forecast h JOIN panel p USING (series_id, ts)""",
    # Class scores for every reading, from its temperature and count; the label is the day's class.
    "scores_det": """
SELECT p.series_id, p.ts, l.cluster AS label, (1 + p.temperature % 7) / z AS p0, (1 + p.temperature % 5) / z AS p1,
       (1 + p.radiation % 3) / z AS p2
FROM (SELECT *, 3 + temperature % 7 + temperature % 5 + radiation % 3 AS z FROM panel) p
JOIN labels_det l USING (series_id, date)""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, in order of their dependence."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name, sql in _VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(sql)
    parts = [f"{n} AS ({_VIEWS[n].strip()})" for n in _VIEWS if n in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body
