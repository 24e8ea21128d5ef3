"""How good a grouping is, and how far two groupings agree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from meterloom.operators.clustering import centroids, squared_distance


def cluster_stats(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per cluster: centroid, members, summed squared distance and mean distance to the centroid.

    Two passes over the days (centroids, then distances); every index but the silhouette follows from this small table.
    """
    own = labelled.join(centroids(labelled, keys), [*keys, "cluster"]).withColumn("dist2", squared_distance("vec", "centroid"))
    return own.groupBy(*keys, "cluster").agg(
        F.sum("dist2").alias("within"), F.avg(F.sqrt("dist2")).alias("spread"), F.count(F.lit(1)).alias("members"), F.first("centroid").alias("centroid")
    )


def inertia(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of squared distances to the own centroid."""
    return _indices(cluster_stats(labelled, keys), keys).select(*keys, "inertia")


TILE = 1024


def silhouette_points(labelled: DataFrame, keys: Sequence[str], point: Sequence[str] = ("date",), tile: int = TILE) -> DataFrame:
    """Euclidean silhouette of every point among the points of its own model: ``keys, point, silhouette``.

    The exact index needs all distances inside a model. Its points are dealt to tiles of about ``tile`` by a hash, every pair of
    tiles is one group of rows, and a group only returns, for each point of its first tile, the sum of distances to each
    cluster of its second. Sums are merged per point. No task holds more than two tiles, distances never become rows, and a
    model of n points is shared by (n / tile)^2 groups.
    """
    keys, point = list(keys), list(point)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in labelled.schema.fields if f.name in [*keys, *point])
    sizes = labelled.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("members"))
    models = sizes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "members"))).alias("sizes"), F.sum("members").alias("n"))
    models = models.withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    dealt = labelled.select(*keys, *point, "cluster", "vec").join(models.select(*keys, "tiles"), keys).withColumn("tile", F.pmod(F.xxhash64(*point), F.col("tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = dealt.withColumn("other", every).select(*keys, F.col("tile").alias("_i"), F.col("other").alias("_j"), F.lit(True).alias("own"), *point, "cluster", "vec")
    right = dealt.withColumn("other", every).select(*keys, F.col("other").alias("_i"), F.col("tile").alias("_j"), F.lit(False).alias("own"), *point, "cluster", "vec")

    def score(key, rows):
        own, other = rows[rows["own"]], rows[~rows["own"]]
        head = {name: key[i] for i, name in enumerate(keys)}
        if own.empty or other.empty:
            return pd.DataFrame(columns=[*keys, *point, "cluster", "toward", "total"])
        x, y = np.stack(own["vec"].to_numpy()), np.stack(other["vec"].to_numpy())
        names, code = np.unique(other["cluster"].to_numpy(), return_inverse=True)
        member = np.eye(len(names))[code]
        step = max(1, 2_000_000 // max(1, y.size))
        sums = np.concatenate([np.sqrt(((x[lo : lo + step, None, :] - y[None, :, :]) ** 2).sum(axis=2)) @ member for lo in range(0, len(x), step)])
        again = {c: np.repeat(own[c].to_numpy(), len(names)) for c in [*point, "cluster"]}
        return pd.DataFrame({**head, **again, "toward": np.tile(names, len(x)), "total": sums.ravel()})

    partial = left.unionByName(right).groupBy(*keys, "_i", "_j").applyInPandas(score, f"{fields}, cluster int, toward int, total double")
    toward = partial.groupBy(*keys, *point, "cluster", "toward").agg(F.sum("total").alias("total"))
    per_point = toward.groupBy(*keys, *point, "cluster").agg(F.collect_list(F.struct("toward", "total")).alias("sums")).join(models, keys)
    mine = F.col("sizes")[F.col("cluster")]
    inner = F.aggregate("sums", F.lit(0.0), lambda s, t: s + F.when(t["toward"] == F.col("cluster"), t["total"]).otherwise(0.0)) / F.greatest(mine - 1, F.lit(1))
    outer = F.array_min(F.transform(F.filter("sums", lambda t: t["toward"] != F.col("cluster")), lambda t: t["total"] / F.col("sizes")[t["toward"]]))
    gaps = per_point.withColumns({"_a": inner, "_b": outer})
    defined = (F.size("sizes") > 1) & (F.size("sizes") < F.col("n")) & (mine > 1)
    value = F.when(defined, F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")))
    return gaps.select(*keys, *point, F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette(labelled: DataFrame, keys: Sequence[str], point: Sequence[str] = ("date",)) -> DataFrame:
    return silhouette_points(labelled, keys, point).groupBy(*keys).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_squared(labelled: DataFrame) -> float:
    """Squared-Euclidean silhouette of one pooled model, linear in the number of rows."""
    data = labelled.select(array_to_vector("vec").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(data)


def _indices(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inertia, Davies-Bouldin and Calinski-Harabasz from the per-cluster table.

    The clusters of a model travel as one array as long as k. Undefined cases give 0.
    """
    table = stats.groupBy(*keys).agg(
        F.collect_list(F.struct("cluster", "spread", "centroid", "members")).alias("_cs"),
        F.sum("within").alias("inertia"), F.sum("members").alias("_n"), F.count(F.lit(1)).alias("_k"),
    )

    def dist2(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)

    worst = F.transform(
        "_cs",
        lambda i: F.array_max(
            F.transform(
                F.filter("_cs", lambda j: j["cluster"] != i["cluster"]),
                lambda j: F.coalesce(F.try_divide(i["spread"] + j["spread"], F.sqrt(dist2(i["centroid"], j["centroid"]))), F.lit(0.0)),
            )
        ),
    )
    ratio = F.aggregate(worst, F.lit(0.0), lambda s, v: s + v) / F.size("_cs")
    first = F.element_at("_cs", 1)["centroid"]
    grand = F.aggregate(
        "_cs", F.transform(first, lambda _: F.lit(0.0)),
        lambda s, c: F.zip_with(s, c["centroid"], lambda t, v: t + v * c["members"] / F.col("_n")),
    )
    between = F.aggregate("_cs", F.lit(0.0), lambda s, c: s + c["members"] * dist2(c["centroid"], F.col("_grand")))
    out = table.withColumn("_grand", grand).withColumn("_b", between)
    ch = F.try_divide(F.col("_b") * (F.col("_n") - F.col("_k")), F.col("inertia") * (F.col("_k") - 1))
    undefined = (F.col("_k") < 2) | (F.col("_n") <= F.col("_k"))
    return out.select(
        *keys, "inertia", F.coalesce(ratio, F.lit(0.0)).alias("davies_bouldin"),
        F.coalesce(F.when(undefined, 0.0).when(F.col("inertia") == 0, 1.0).otherwise(ch), F.lit(0.0)).alias("calinski_harabasz"),
    )


def davies_bouldin(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over clusters of the worst ratio of summed spreads to centroid distance; fewer than two clusters give 0."""
    return _indices(cluster_stats(labelled, keys), keys).select(*keys, "davies_bouldin")


def calinski_harabasz(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Between over within dispersion, each per degree of freedom; undefined cases give 0."""
    return _indices(cluster_stats(labelled, keys), keys).select(*keys, "calinski_harabasz")


def validity_table(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inertia and the three validity indices per model. ``labelled`` is read three times, so hand in a stored table."""
    return _indices(cluster_stats(labelled, keys), keys).join(silhouette(labelled, keys), list(keys))


def best_k(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """k with the largest silhouette and k with the least positive Davies-Bouldin index; ties go to the smaller k."""
    return table.groupBy(*keys).agg(
        F.max_by("k", F.struct(F.col("silhouette"), -F.col("k"))).alias("best_silhouette_k"),
        F.min_by("k", F.when(F.col("davies_bouldin") > 0, F.struct(F.col("davies_bouldin"), F.col("k")))).alias("best_db_k"),
    )


def _contingency(labels: DataFrame, names: Sequence, keys: Sequence[str], by: str) -> DataFrame:
    wide = labels.groupBy(*keys, "date").agg(*[F.max(F.when(F.col(by) == n, F.col("cluster"))).alias(f"l{i}") for i, n in enumerate(names)])
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"l{i}").alias("x"), F.col(f"l{j}").alias("y"))
            for i, a in enumerate(names)
            for j, b in enumerate(names)
        ]
    )
    rows = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").dropna(subset=["x", "y"])
    return rows.groupBy(*keys, "left", "right", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))


def label_agreement(labels: DataFrame, names: Sequence, keys: Sequence[str] = ("series_id",), by: str = "config_id") -> DataFrame:
    """Adjusted Rand index and normalised mutual information for every pair of the named labellings.

    The days are counted once per pair of labels; everything after that works on the small contingency table.
    """
    on = [*keys, "left", "right"]
    cells = _contingency(labels, names, keys, by)
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    cell = cells.groupBy(*on).agg(
        F.sum(pairs).alias("cc"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("cl")
    )

    def margin(axis: str, prefix: str) -> DataFrame:
        m = cells.groupBy(*on, axis).agg(F.sum("n").alias("n"))
        return m.groupBy(*on).agg(
            F.sum(pairs).alias(f"{prefix}c"), F.sum(F.col("n") * F.log("n")).alias(f"{prefix}l"), F.count(F.lit(1)).alias(f"{prefix}k")
        )

    t = cell.join(margin("x", "a"), on).join(margin("y", "b"), on)
    total = F.col("total")
    expected = F.coalesce(F.try_divide(F.col("ac") * F.col("bc"), total * (total - 1) / 2.0), F.lit(0.0))
    ceiling = (F.col("ac") + F.col("bc")) / 2.0
    ari = F.when(F.abs(ceiling - expected) < 1e-12, F.lit(1.0)).otherwise((F.col("cc") - expected) / F.nullif(ceiling - expected, F.lit(0.0)))
    mutual = (F.col("cl") - F.col("al") - F.col("bl")) / total + F.log(total)
    entropy = (F.log(total) * 2.0 - (F.col("al") + F.col("bl")) / total) / 2.0
    nmi = F.when((F.col("ak") == 1) & (F.col("bk") == 1), F.lit(1.0)).otherwise(
        F.greatest(F.coalesce(F.try_divide(mutual, entropy), F.lit(0.0)), F.lit(0.0))
    )
    return t.select(*on, ari.alias("ari"), nmi.alias("nmi"))
