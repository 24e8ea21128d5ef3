import numpy as np
from pyspark.sql import functions as F

from meterloom.operators import clustering, intervals, validity
from meterloom.plans import reports, shapes
from meterloom.session import materialise


def test_two_shapes_are_recovered(twin):
    s = shapes.shape_days(twin, ks=(2,), variants=("filter",))
    split = s.labels.groupBy("series_id", "config_id", "cluster").agg(F.count_if(F.weekday("date") >= 5).alias("e"), F.count(F.lit(1)).alias("n")).collect()
    assert len(split) == 3 * 4 * 2
    assert all(r["e"] in (0, r["n"]) for r in split)
    assert s.profiles.count() == 3 * 4 * 2 * 96


def test_cost_falls_with_k_and_labels_are_stable(twin):
    s = shapes.shape_days(twin, ks=(2, 3, 4), configs=[1], variants=("raw",))
    cost = {(r["series_id"], r["k"]): r["inertia"] for r in s.labels.select("series_id", "k", "inertia").distinct().collect()}
    for m in ("m1", "m2", "m3"):
        assert cost[m, 2] >= cost[m, 3] >= cost[m, 4] > 0
    again = clustering.cluster_days(s.vectors, (2, 3, 4), ("series_id", "variant", "config_id"))
    assert s.labels.select(again.columns).exceptAll(again).count() == 0
    # Ids follow the centroid mean.
    low = s.labels.filter("k = 2").join(s.vectors, ["series_id", "variant", "config_id", "date"])
    canon = clustering.canonical_labels(low.drop("inertia"), ["series_id", "variant", "config_id", "k"])
    assert canon.select("series_id", "date", "cluster").exceptAll(low.select("series_id", "date", "cluster")).count() == 0


def test_restarts_only_help_and_too_few_days_give_no_model(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    one = clustering._fit_group(x, 4, 1, 42)[1]
    assert clustering._fit_group(x, 4, 10, 42)[1] <= one + 1e-9
    df = spark.createDataFrame([("a", "2021-01-01", [1.0, 2.0])], "series_id string, d string, vec array<double>").select("series_id", F.to_date("d").alias("date"), "vec")
    assert clustering.cluster_days(df, (2,), ("series_id",)).count() == 0


def test_pooled_model_agrees_with_nearest_centroid(twin):
    wide = intervals.interval_means_wide(twin, "total", configs=[1])
    vectors = materialise(intervals.interval_vectors(wide, configs=[1]).filter("series_id = 'm1'").drop("config_id"), "v")
    pooled = materialise(clustering.cluster_days_pooled(vectors, (2,), restarts=3), "pooled")
    mine = clustering.cluster_days(vectors, (2,), ("series_id",))
    assert pooled.select("date", "cluster").exceptAll(mine.select("date", "cluster")).count() == 0
    cost = validity.inertia(pooled, ["series_id"]).first()["inertia"]
    assert abs(cost - pooled.first()["inertia"]) < 1e-6
    near = clustering.assign_nearest(vectors, clustering.centroids(pooled, ["series_id"]), ["series_id"])
    assert near.select("date", "cluster").exceptAll(pooled.select("date", "cluster")).count() == 0


def test_silhouette_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) + np.repeat([[0], [2], [5]], [30, 29, 1], axis=0)
    lab = np.repeat([0, 1, 2], [30, 29, 1])
    rows = [("a", f"2021-{1 + i // 28:02d}-{1 + i % 28:02d}", int(lab[i]), [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, d string, cluster int, vec array<double>").withColumn("date", F.to_date("d"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        own = lab == lab[i]
        if own.sum() == 1:
            want.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = validity.silhouette(df, ["series_id"]).first()["silhouette"]
    assert abs(got - np.mean(want)) < 1e-9


def test_identical_labellings_agree_fully(spark):
    rows = [("a", f"2021-01-{d:02d}", c, d % 3 if c < 3 else 0) for d in range(1, 25) for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "series_id string, d string, config_id int, cluster int").withColumn("date", F.to_date("d"))
    got = {(r["left"], r["right"]): (r["ari"], r["nmi"]) for r in validity.label_agreement(df, [1, 2, 3]).collect()}
    np.testing.assert_allclose(got[1, 2], (1.0, 1.0))
    np.testing.assert_allclose(got[3, 3], (1.0, 1.0))
    np.testing.assert_allclose(got[1, 3], (0.0, 0.0), atol=1e-12)


def test_sweep_names_the_right_k(twin):
    wide = intervals.interval_means_wide(twin, "total", configs=[1])
    vectors = materialise(intervals.interval_vectors(wide, configs=[1]).drop("config_id"), "v")
    table = reports.validity_curves(vectors, (2, 3, 4), restarts=3)
    assert table.count() == 9
    assert {r["best_silhouette_k"] for r in validity.best_k(table, ["series_id"]).collect()} == {2}
