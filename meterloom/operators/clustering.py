"""Grouping days into recurring shapes.

Two scopes. ``cluster_days`` fits one model per series: a series has one vector per calendar day, so a group is bounded
by the calendar and is fitted inside one task while the groups run in parallel; the work per series is one pass over the
data instead of one Spark job per iteration and restart. ``cluster_days_pooled`` fits one distributed model over the days
of all series, for which the number of fits does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.session import materialise, run_parallel

RESTARTS = 10
SEED = 42


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    own = d.argmin(axis=1)
    return own, d[np.arange(len(x)), own]


def _spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        d = _nearest(x, np.array(centres))[1]
        total = d.sum()
        pick = rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))
        centres.append(x[pick])
    return np.array(centres)


def _fit_group(x: np.ndarray, k: int, restarts: int, seed: int, max_iter: int = 300, tol: float = 1e-4):
    """Best of several restarts; labels ordered by centroid mean, then by the first coordinate."""
    limit = tol * float(x.var(axis=0).mean())
    best = None
    for r in range(restarts):
        centres = _spread_seeds(x, k, np.random.default_rng(seed + r))
        for _ in range(max_iter):
            own, d = _nearest(x, centres)
            moved = centres.copy()
            for c in range(k):
                mine = own == c
                # An emptied cluster takes over the point that fits its own cluster worst.
                moved[c] = x[mine].mean(axis=0) if mine.any() else x[d.argmax()]
            shift = float(((moved - centres) ** 2).sum())
            centres = moved
            if shift <= limit:
                break
        own, d = _nearest(x, centres)
        if best is None or d.sum() < best[1] - 1e-12:
            best = (own, float(d.sum()), centres)
    own, inertia, centres = best
    order = np.lexsort((centres[:, 0], centres.mean(axis=1)))
    return np.argsort(order)[own], inertia


def cluster_days(
    vectors: DataFrame,
    ks: Sequence[int] = (2, 3),
    keys: Sequence[str] = ("series_id", "config_id"),
    restarts: int = RESTARTS,
    seed: int = SEED,
) -> DataFrame:
    """Label every day of every series for each k: ``keys, k, date, cluster, inertia``.

    ``vectors`` holds one row per ``keys`` and ``date`` with an array ``vec``. A series with fewer days than k has no
    model for that k and yields no rows, as a fit over too few days fails in the first place.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in keys)
    schema = f"{fields}, k int, date date, cluster int, inertia double"

    def fit(key, days):
        days = days.sort_values("date")
        x, out = np.stack(days["vec"].to_numpy()), []
        head = {name: key[i] for i, name in enumerate(keys)}
        for k in ks:
            if len(x) >= k:
                labels, inertia = _fit_group(x, int(k), restarts, seed)
                out.append(pd.DataFrame({**head, "k": int(k), "date": days["date"].to_numpy(), "cluster": labels, "inertia": inertia}))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, "k", "date", "cluster", "inertia"])

    # One group for all k: the vectors of a series are sent once.
    return vectors.select(*keys, "date", "vec").groupBy(*keys).applyInPandas(fit, schema)


def cluster_days_pooled(
    vectors: DataFrame,
    ks: Sequence[int] = (2, 3),
    restarts: int = RESTARTS,
    seed: int = SEED,
    init: str = "k-means||",
) -> DataFrame:
    """One distributed model per k over the days of all series; the restart with the least cost is kept."""
    data = materialise(vectors, "vectors").withColumn("features", array_to_vector("vec"))

    def fit(k: int, r: int):
        model = KMeans(k=k, seed=seed + r, initMode=init, tol=1e-4, maxIter=300, featuresCol="features", predictionCol="cluster")
        return model.fit(data)

    runs = run_parallel([(lambda k=k, r=r: (k, fit(k, r))) for k in ks for r in range(restarts)])
    parts = []
    for k in ks:
        fits = [m for kk, m in runs if kk == k]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        order = np.lexsort((np.array(best.clusterCenters())[:, 0], np.array(best.clusterCenters()).mean(axis=1)))
        rank = F.array(*[F.lit(int(r)) for r in np.argsort(order)])
        parts.append(
            best.transform(data)
            .withColumn("cluster", F.element_at(rank, F.col("cluster") + 1))
            .withColumn("k", F.lit(k))
            .withColumn("inertia", F.lit(float(best.summary.trainingCost)))
            .drop("features")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def centroids(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean vector and size of each cluster, aggregated map-side first."""
    return (
        labelled.groupBy(*keys, "cluster")
        .agg(Summarizer.mean(array_to_vector(F.col("vec"))).alias("_c"), F.count(F.lit(1)).alias("members"))
        .select(*keys, "cluster", vector_to_array("_c").alias("centroid"), "members")
    )


def canonical_labels(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Renumber clusters by ascending centroid mean, then by the first coordinate."""
    c = centroids(labelled, keys)
    mean = F.aggregate("centroid", F.lit(0.0), lambda s, v: s + v) / F.size("centroid")
    w = Window.partitionBy(*keys).orderBy(mean, F.element_at("centroid", 1), "cluster")
    ranks = c.select(*keys, "cluster", (F.row_number().over(w) - 1).alias("_rank"))
    return labelled.join(ranks, [*keys, "cluster"]).withColumn("cluster", F.col("_rank")).drop("_rank")


def assign_nearest(vectors: DataFrame, centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest centroid of each row. ``centres``: keys, cluster, centroid. A model has a handful of centroids, so they
    travel as one short array per key and rows are not multiplied by them."""
    table = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid"))).alias("_cs"))
    scored = F.transform(
        "_cs",
        lambda c: F.struct(
            F.aggregate(
                F.zip_with(F.col("vec"), c["centroid"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d
            ).alias("dist2"),
            c["cluster"].alias("cluster"),
        ),
    )
    return (
        vectors.join(table, list(keys))
        .withColumn("_best", F.array_min(scored))
        .withColumn("cluster", F.col("_best.cluster"))
        .withColumn("dist2", F.col("_best.dist2"))
        .drop("_best", "_cs")
    )


def attach_labels(table: DataFrame, labels: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Labels joined by series and date, never by position."""
    return table.join(labels, [*keys, "date"], "inner")


def mean_profiles(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average value per cluster and slot; nulls do not count."""
    return slots.groupBy(*keys, "cluster", "slot").agg(F.avg("value").alias("value"))


def cluster_sizes(labels: DataFrame, keys: Sequence[str], k: str | int = "k") -> DataFrame:
    """Days per cluster, with the empty clusters as 0."""
    kcol = F.lit(k) if isinstance(k, int) else F.col(k)
    counted = labels.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("days"))
    span = labels.select(*keys).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), (kcol - 1).cast("int"))))
    return span.join(counted, [*keys, "cluster"], "left").withColumn("days", F.coalesce("days", F.lit(0)))


def weekday_split(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weekday and weekend days per cluster with their share in percent."""
    out = labels.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.weekday("date") < 5).alias("weekdays"),
        F.count_if(F.weekday("date") >= 5).alias("weekends"),
    )
    return out.withColumns(
        {
            "weekday_share": F.lit(100.0) * F.col("weekdays") / F.col("days"),
            "weekend_share": F.lit(100.0) * F.col("weekends") / F.col("days"),
        }
    )
