"""Clustering of days, validity indices and agreement of labellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterloom.catalog.features import det_vectors, imeans_wide
from meterloom.catalog.registry import register
from meterloom.catalog.tables import day_labels, panel, scaled
from meterloom.operators import clustering, intervals, ranking, reshape, validity
from meterloom.plans import reports, shapes
from meterloom.sources import panels


def det_labelled(spark, sf):
    return det_vectors(spark, sf).join(day_labels(spark, sf).drop("cluster2"), ["series_id", "date"])


@register("i1_kmeans_per_series", "series_id variant config_id:i k:i date:d cluster:i inertia:6")
def i1(spark, sf):
    return clustering.cluster_days(intervals.interval_vectors(imeans_wide(spark, sf), ("series_id", "variant")), (2, 3), ("series_id", "variant", "config_id"))


@register("i1_kmeans_pooled", "series_id date:d k:i cluster:i inertia:6")
def i1_pooled(spark, sf):
    return clustering.cluster_days_pooled(det_vectors(spark, sf), (2, 3))


@register("i2_canonical_labels", "series_id date:d cluster:i",
          """WITH m AS (SELECT series_id, cluster, avg(c) AS mean, max(CASE WHEN ival = 'I1' THEN c END) AS first FROM cent1 GROUP BY 1, 2),
                  r AS (SELECT series_id, cluster, row_number() OVER (PARTITION BY series_id ORDER BY mean, first, cluster) - 1 AS place FROM m)
             SELECT l.series_id, l.date, r.place AS cluster FROM labels_det l JOIN r USING (series_id, cluster)""")
def i2(spark, sf):
    return clustering.canonical_labels(det_labelled(spark, sf), ["series_id"])


# Fixed centroids for the nearest-centroid check: the interval vectors of each series' first three days.
_FIRST3 = """c3 AS (SELECT v.series_id, v.date - f.d AS cluster, v.ival, v.value AS c FROM vec1 v
   JOIN (SELECT series_id, min(date) AS d FROM vec1 GROUP BY 1) f ON f.series_id = v.series_id AND v.date < f.d + 3),
 dd AS (SELECT v.series_id, v.date, c3.cluster, sum((v.value - c3.c) * (v.value - c3.c)) AS dist2 FROM vec1 v JOIN c3 USING (series_id, ival) GROUP BY ALL)"""


def first3(spark, sf):
    v = det_vectors(spark, sf)
    first = v.groupBy("series_id").agg(F.min("date").alias("d"))
    centres = v.join(first, "series_id").filter(F.date_diff("date", "d") < 3).select("series_id", F.date_diff("date", "d").alias("cluster"), F.col("vec").alias("centroid"))
    return clustering.assign_nearest(v, centres, ["series_id"])


@register("i3_nearest_centroid", "series_id date:d cluster:i dist2:6",
          f"WITH {_FIRST3} SELECT series_id, date, arg_min(cluster, dist2) AS cluster, min(dist2) AS dist2 FROM dd GROUP BY 1, 2")
def i3(spark, sf):
    return first3(spark, sf)


@register("i4_kmeans_full_profiles", "series_id target k:i cluster:i slot:i value:6 days:i")
def i4(spark, sf):
    p = panel(spark, sf).select("series_id", "ts", "total", "total_filter")
    return reports.report_dataset(p, ["total", "total_filter"], range(2, 10))[0]


@register("i5_k_sweep", "series_id k:i inertia:6 silhouette:6 davies_bouldin:6 calinski_harabasz:6")
def i5(spark, sf):
    return reports.validity_curves(det_vectors(spark, sf))


@register("i6_inertia", "series_id inertia:6", "SELECT series_id, sum(dist2) AS inertia FROM own1 GROUP BY 1")
def i6(spark, sf):
    return validity.inertia(det_labelled(spark, sf), ["series_id"])


@register("i7_silhouette", "series_id silhouette:6",
          """WITH d AS (SELECT a.series_id, a.date, a.cluster, b.date AS other, b.cluster AS oc, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS dist
                        FROM lvec1 a JOIN lvec1 b ON a.series_id = b.series_id AND a.ival = b.ival GROUP BY ALL),
                  m AS (SELECT series_id, date, cluster, oc, CASE WHEN oc = cluster THEN sum(dist) / nullif(count(*) - 1, 0) ELSE avg(dist) END AS mean FROM d GROUP BY series_id, date, cluster, oc),
                  s AS (SELECT series_id, date, max(CASE WHEN oc = cluster THEN mean END) AS a, min(CASE WHEN oc <> cluster THEN mean END) AS b FROM m GROUP BY 1, 2)
             SELECT series_id, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM s GROUP BY 1""")
def i7(spark, sf):
    return validity.silhouette(det_labelled(spark, sf), ["series_id"])


@register("i7_silhouette_squared_pooled", "rows:i silhouette_sq:6",
          """WITH n AS (SELECT cluster, ival, avg(value) AS mu, avg(value * value) AS q, count(*) AS m FROM lvec1 GROUP BY 1, 2),
                  d AS (SELECT v.series_id, v.date, v.cluster, n.cluster AS oc, any_value(n.m) AS m, sum(v.value * v.value - 2 * v.value * n.mu + n.q) AS mean
                        FROM lvec1 v JOIN n ON v.ival = n.ival GROUP BY v.series_id, v.date, v.cluster, n.cluster),
                  s AS (SELECT series_id, date, max(CASE WHEN oc = cluster THEN mean * m / (m - 1) END) AS a, min(CASE WHEN oc <> cluster THEN mean END) AS b FROM d GROUP BY 1, 2)
             SELECT count(*) AS rows, avg((b - a) / greatest(a, b)) AS silhouette_sq FROM s""")
def i7_sq(spark, sf):
    labelled = det_labelled(spark, sf)
    value = validity.silhouette_squared(labelled)
    return labelled.agg(F.count(F.lit(1)).alias("rows")).withColumn("silhouette_sq", F.lit(value))


@register("i8_davies_bouldin", "series_id davies_bouldin:6",
          """WITH s AS (SELECT series_id, cluster, avg(sqrt(dist2)) AS s FROM own1 GROUP BY 1, 2),
                  p AS (SELECT a.series_id, a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cent1 a JOIN cent1 b ON a.series_id = b.series_id AND a.ival = b.ival AND a.cluster <> b.cluster GROUP BY 1, 2, 3),
                  r AS (SELECT p.series_id, p.i, max((x.s + y.s) / p.d) AS worst FROM p JOIN s x ON x.series_id = p.series_id AND x.cluster = p.i JOIN s y ON y.series_id = p.series_id AND y.cluster = p.j GROUP BY 1, 2)
             SELECT series_id, avg(worst) AS davies_bouldin FROM r GROUP BY 1""")
def i8(spark, sf):
    return validity.davies_bouldin(det_labelled(spark, sf), ["series_id"])


_CH = """WITH g AS (SELECT series_id, ival, avg(value) AS g FROM lvec1 GROUP BY 1, 2),
                  n AS (SELECT series_id, cluster, count(DISTINCT date) AS m FROM lvec1 GROUP BY 1, 2),
                  b AS (SELECT c.series_id, sum(n.m * (c.c - g.g) * (c.c - g.g)) AS b FROM cent1 c JOIN g USING (series_id, ival) JOIN n USING (series_id, cluster) GROUP BY 1),
                  w AS (SELECT series_id, sum(dist2) AS w, count(*) AS n, count(DISTINCT cluster) AS k FROM own1 GROUP BY 1)
             SELECT series_id, (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM b JOIN w USING (series_id)"""


@register("i9_calinski_harabasz", "series_id calinski_harabasz:6", _CH)
def i9(spark, sf):
    return validity.calinski_harabasz(det_labelled(spark, sf), ["series_id"])


@register("i10_undefined_indices", "series_id inertia:6 silhouette:6 davies_bouldin:6 calinski_harabasz:6",
          """SELECT series_id, sum(q) AS inertia, 0 AS silhouette, 0 AS davies_bouldin, 0 AS calinski_harabasz FROM (
               SELECT v.series_id, v.date, sum((v.value - g.g) * (v.value - g.g)) AS q FROM vec1 v
               JOIN (SELECT series_id, ival, avg(value) AS g FROM vec1 GROUP BY 1, 2) g USING (series_id, ival) GROUP BY 1, 2) GROUP BY 1""")
def i10(spark, sf):
    return validity.validity_table(det_vectors(spark, sf).withColumn("cluster", F.lit(0)), ["series_id"])


# Three labellings of the same days: the weekday class, the day number modulo 3, and both combined.
_LABELLINGS = """lab AS (SELECT series_id, date, 1 AS name, cluster AS c FROM labels_det UNION ALL SELECT series_id, date, 2, cluster2 FROM labels_det
   UNION ALL SELECT series_id, date, 3, (cluster + cluster2) % 2 FROM labels_det),
 cell AS (SELECT a.series_id, a.name AS lft, b.name AS rgt, a.c AS x, b.c AS y, CAST(count(*) AS DOUBLE) AS n FROM lab a JOIN lab b ON a.series_id = b.series_id AND a.date = b.date GROUP BY ALL),
 rx AS (SELECT series_id, lft, rgt, x, sum(n) AS n FROM cell GROUP BY ALL), ry AS (SELECT series_id, lft, rgt, y, sum(n) AS n FROM cell GROUP BY ALL)"""
_ARI = f"""WITH {_LABELLINGS}, s AS (SELECT c.series_id, c.lft, c.rgt, any_value(t.n) AS n, sum(c.n * (c.n - 1) / 2) AS cc, any_value(a.ac) AS ac, any_value(b.bc) AS bc
   FROM cell c JOIN (SELECT series_id, lft, rgt, sum(n) AS n FROM cell GROUP BY ALL) t USING (series_id, lft, rgt)
   JOIN (SELECT series_id, lft, rgt, sum(n * (n - 1) / 2) AS ac FROM rx GROUP BY ALL) a USING (series_id, lft, rgt)
   JOIN (SELECT series_id, lft, rgt, sum(n * (n - 1) / 2) AS bc FROM ry GROUP BY ALL) b USING (series_id, lft, rgt) GROUP BY 1, 2, 3)
 SELECT series_id, lft, rgt, (cc - ac * bc / (n * (n - 1) / 2)) / ((ac + bc) / 2 - ac * bc / (n * (n - 1) / 2)) AS ari FROM s"""
_NMI = f"""WITH {_LABELLINGS}, t AS (SELECT series_id, lft, rgt, sum(n) AS n FROM cell GROUP BY ALL),
 mi AS (SELECT c.series_id, c.lft, c.rgt, sum(c.n / t.n * ln(c.n * t.n / (a.n * b.n))) AS mi FROM cell c JOIN t USING (series_id, lft, rgt)
   JOIN rx a ON a.series_id = c.series_id AND a.lft = c.lft AND a.rgt = c.rgt AND a.x = c.x JOIN ry b ON b.series_id = c.series_id AND b.lft = c.lft AND b.rgt = c.rgt AND b.y = c.y GROUP BY ALL),
 hx AS (SELECT series_id, lft, rgt, -sum(rx.n / t.n * ln(rx.n / t.n)) AS h FROM rx JOIN t USING (series_id, lft, rgt) GROUP BY ALL),
 hy AS (SELECT series_id, lft, rgt, -sum(ry.n / t.n * ln(ry.n / t.n)) AS h FROM ry JOIN t USING (series_id, lft, rgt) GROUP BY ALL)
 SELECT mi.series_id, mi.lft, mi.rgt, greatest(mi.mi, 0) / ((hx.h + hy.h) / 2) AS nmi FROM mi JOIN hx USING (series_id, lft, rgt) JOIN hy USING (series_id, lft, rgt)"""


def _matrix_sql(body: str, measure: str) -> str:
    cells = ", ".join(f"max(CASE WHEN rgt = {i} THEN {measure} END) AS c{i}" for i in (1, 2, 3))
    return f"SELECT series_id, lft, {cells} FROM ({body}) GROUP BY 1, 2"


ARI_MATRIX, NMI_MATRIX = _matrix_sql(_ARI, "ari"), _matrix_sql(_NMI, "nmi")


def labellings(spark, sf):
    d = day_labels(spark, sf)
    three = F.array(*[F.struct(F.lit(i).alias("config_id"), c.alias("cluster")) for i, c in enumerate(
        [F.col("cluster"), F.col("cluster2"), (F.col("cluster") + F.col("cluster2")) % 2], 1)])
    return d.select("series_id", "date", F.explode(three).alias("l")).select("series_id", "date", "l.*")


def _agreement(spark, sf):
    return validity.label_agreement(labellings(spark, sf), [1, 2, 3]).withColumnsRenamed({"left": "lft", "right": "rgt"})


@register("i11_adjusted_rand", "series_id lft:i rgt:i ari:6", _ARI)
def i11(spark, sf):
    return _agreement(spark, sf)


@register("i12_mutual_information", "series_id lft:i rgt:i nmi:6", _NMI)
def i12(spark, sf):
    return _agreement(spark, sf)


@register("i13_labels_attached", "series_id date:d slot:i value:6 cluster:i",
          "SELECT s.series_id, s.date, s.slot, s.scaled AS value, l.cluster FROM scaled s JOIN labels_det l USING (series_id, date) WHERE s.variant = 'raw'")
def i13(spark, sf):
    slots = reshape.day_slots(scaled(spark, sf).filter("variant = 'raw'"), "scaled")
    return clustering.attach_labels(slots, day_labels(spark, sf))


@register("g16_best_k", "series_id best_silhouette_k:i best_db_k:i",
          """WITH t AS (SELECT series_id, month(date) AS k, round(avg(total), 0) % 7 AS sil, round(sum(n), 0) % 5 - 1 AS db FROM orders_days GROUP BY 1, 2)
             SELECT series_id, arg_max(k, sil * 100 - k) AS best_silhouette_k, arg_min(k, db * 100 + k) FILTER (WHERE db > 0) AS best_db_k FROM t GROUP BY 1""")
def g16(spark, sf):
    o = panels.orders_panel(spark, sf).groupBy("series_id", F.month("date").alias("k")).agg(
        (F.round(F.avg("total"), 0) % 7).alias("silhouette"), (F.sum("n").cast("double") % 5 - 1).alias("davies_bouldin"))
    return validity.best_k(o, ["series_id"])


@register("stage1_shapes", "series_id variant k:i config_id:i cluster:i slot:i value:6 days:i")
def stage1(spark, sf):
    s = shapes.shape_days(panel(spark, sf), ks=(2, 3))
    keys = ["series_id", "variant", "config_id", "k"]
    return s.profiles.join(clustering.cluster_sizes(s.labels, keys), [*keys, "cluster"])
