"""Boosted trees, tube regression and kernel maps against plain NumPy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meterloom.learners import boosting, kernels, models, tube
from meterloom.session import materialise


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 3.0, -1.0) + np.where(x[:, 1] > -0.2, 0.7, 0.0) * x[:, 2] + rng.normal(0, 0.1, 300)
    return x, y, np.digitize(y, [0.0, 2.8])


@pytest.fixture(scope="module")
def table(spark, numbers):
    x, y, c = numbers
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), int(c[i])) for i in range(len(y))], "vec array<double>, y double, c int").repartition(3)
    return materialise(df.withColumn("features", array_to_vector("vec")).withColumn("label", F.col("y")), "boost-rows")


def plain(x, label, o, classes, cuts):
    """Boosting by search over all cuts of all nodes, the largest gain first; no sampling."""
    bins = boosting.binned(x, cuts)
    count = classes if classes > 2 else 1
    start = np.array([label.mean()]) if classes == 0 else np.array([np.log(label.mean() / (1 - label.mean()))]) if classes == 2 else np.zeros(classes)
    margin = np.tile(start, (len(x), 1))
    soft = lambda g: np.sign(g) * max(abs(g) - o.l1, 0)
    for _ in range(o.rounds):
        g, h = boosting._gradients(margin, label, classes)
        for k in range(count):
            def best(rows):
                out = None
                G, H = g[rows, k].sum(), h[rows, k].sum()
                for f in range(x.shape[1]):
                    for b in range(len(cuts[f])):
                        left = rows[bins[f, rows] <= b]
                        if len(left) in (0, len(rows)) or not (bins[f, rows] == b).any():
                            continue
                        gl, hl = g[left, k].sum(), h[left, k].sum()
                        if min(hl, H - hl) < o.child_weight or min(len(left), len(rows) - len(left)) < o.child_rows:
                            continue
                        gain = round((soft(gl) ** 2 / (hl + o.l2) + soft(G - gl) ** 2 / (H - hl + o.l2) - soft(G) ** 2 / (H + o.l2)) / 2 - o.gain, 10)
                        if gain > 0 and (out is None or gain > out[0]):
                            out = (gain, f, b)
                return out
            leaves = [(np.arange(len(x)), 0)]
            cut = {0: best(leaves[0][0])}
            n_leaves = 1
            while o.leaves is None or n_leaves < o.leaves:
                open_ = [i for i, (r, d) in enumerate(leaves) if r is not None and d < o.depth and cut.get(i)]
                if not open_:
                    break
                i = max(open_, key=lambda i: (cut[i][0], -i))
                rows, depth = leaves[i]
                _, f, b = cut[i]
                leaves[i] = (None, depth)
                for part in (rows[bins[f, rows] <= b], rows[bins[f, rows] > b]):
                    leaves.append((part, depth + 1))
                    cut[len(leaves) - 1] = best(part) if depth + 1 < o.depth else None
                n_leaves += 1
            if n_leaves > 1:
                for rows, _ in leaves:
                    if rows is not None:
                        margin[rows, k] += -o.rate * soft(g[rows, k].sum()) / (h[rows, k].sum() + o.l2)
    return margin


@pytest.mark.parametrize("classes,o", [
    (0, boosting.Options(rounds=4, depth=3, bins=16)),
    (0, boosting.Options(rounds=3, depth=4, bins=12, leaves=5, l1=0.5, l2=0.3, child_rows=9, gain=0.2)),
    (2, boosting.Options(rounds=3, depth=2, bins=10, child_weight=4.0)),
    (3, boosting.Options(rounds=2, depth=3, bins=8, leaves=4, rate=0.5)),
])
def test_trees_equal_a_search_over_all_cuts(table, numbers, classes, o, monkeypatch):
    monkeypatch.setattr(boosting, "STORE", 2)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    x, y, c = numbers
    label = y if classes == 0 else (c > 0).astype(float) if classes == 2 else c.astype(float)
    data = table.withColumn("label", F.col("y") if classes == 0 else (F.col("c") > 0).cast("double") if classes == 2 else F.col("c").cast("double"))
    model = boosting.fit(data, o, classes)
    np.testing.assert_allclose(model.margins(x), plain(x, label, o, classes, model.cuts), atol=1e-8)
    assert o.leaves is None or all(sum(f >= 0 for f in t.feature) < o.leaves for r in model.rounds for t in r)


def test_a_planted_cut_is_found_exactly(spark):
    values = np.arange(200) / 8
    df = spark.createDataFrame([([float(v), float((i * 7) % 13)], 5.0 if v > 11.375 else -2.0) for i, v in enumerate(values)], "vec array<double>, label double")
    model = boosting.fit(df.withColumn("features", array_to_vector("vec")), boosting.Options(rounds=1, rate=1.0, depth=3, l2=0.0))
    tree = model.rounds[0][0]
    assert tree.feature[0] == 0 and model.cuts[0][tree.bin[0]] == 11.375
    assert sorted(set(model.margins(np.array([[11.375, 0], [11.5, 0], [0, 5], [30, 5]])).ravel().round(9))) == [-2.0, 5.0]


def _shape(model):
    return [[(t.feature, t.bin, np.round(t.value, 9).tolist()) for t in r] for r in model.rounds]


def test_every_option_changes_the_trees(table):
    base = boosting.Options(rounds=2, depth=4, bins=32)
    seen = [_shape(boosting.fit(table, base))]
    for change in ({"rate": 0.3}, {"depth": 2}, {"leaves": 4}, {"child_weight": 30.0}, {"child_rows": 40}, {"gain": 3.0}, {"l1": 5.0}, {"l2": 20.0},
                   {"rows": 0.6}, {"columns": 0.4}, {"bins": 6}, {"level_cuts": True}, {"rounds": 3}):
        shape = _shape(boosting.fit(table, replace(base, **change)))
        assert shape not in seen, change
        seen.append(shape)
    assert _shape(boosting.fit(table, replace(base, rows=0.6))) in seen
    level = boosting.fit(table, replace(base, level_cuts=True)).rounds[0][0]
    assert len({(f, b) for f, b in zip(level.feature, level.bin) if f >= 0}) <= 4


def test_families_read_their_own_parameter_names():
    x = boosting.options("XGBoost", {"n_estimators": "7", "min_child_weight": "3", "gamma": "0.5", "colsample_bytree": "0.6"})
    assert (x.rounds, x.child_weight, x.gain, x.columns, x.l2, x.leaves) == (7, 3.0, 0.5, 0.6, 1.0, None)
    g = boosting.options("LightGBM", {"num_leaves": 20, "min_child_samples": 5, "reg_alpha": 0.2, "reg_lambda": 0.4})
    assert (g.leaves, g.child_rows, g.l1, g.l2) == (20, 5, 0.2, 0.4)
    c = boosting.options("CatBoost", {"iterations": 9, "l2_leaf_reg": 4.0, "border_count": 32})
    assert (c.rounds, c.l2, c.bins, c.level_cuts) == (9, 4.0, 32, True)


# ---- tube regression ----------------------------------------------------------------------------------------------


def by_coordinates(x, y, c, epsilon, sweeps=4000):
    """The dual problem by plain coordinate descent; the bias by the points on the edge of the tube."""
    from itertools import repeat

    k = x @ x.T
    beta, n = np.zeros(len(y)), len(y)
    rng = np.random.default_rng(0)
    for _ in repeat(None, sweeps):  # pairs keep the sum of the dual weights at 0
        i, j = rng.choice(n, 2, replace=False)
        eta = k[i, i] + k[j, j] - 2 * k[i, j]
        if eta <= 1e-12:
            continue
        f = k @ beta
        total = beta[i] + beta[j]
        lo, hi = max(-c, total - c), min(c, total + c)
        grid = [lo, hi, min(max(0.0, lo), hi), min(max(total, lo), hi)]
        for si in (-1, 1):
            for sj in (-1, 1):
                step = ((y[i] - y[j]) - (f[i] - f[j]) - epsilon * (si - sj)) / eta
                grid.append(min(max(beta[i] + step, lo), hi))
        cost = [0.5 * eta * (b - beta[i]) ** 2 + (b - beta[i]) * ((f[i] - f[j]) - (y[i] - y[j])) + epsilon * (abs(b) + abs(total - b)) for b in grid]
        beta[i] = grid[int(np.argmin(cost))]
        beta[j] = total - beta[i]
    return x.T @ beta


def objective(x, y, w, b, c, epsilon):
    return 0.5 * w @ w + c * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum()


@pytest.mark.parametrize("c,epsilon", [(1.0, 0.1), (0.05, 0.5), (20.0, 0.3)])
def test_tube_regression_reaches_the_least_objective(spark, c, epsilon):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([1.0, -2.0, 0.0]) + 4 + rng.standard_t(3, 200) * 0.4
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(200)], "vec array<double>, label double").withColumn("features", array_to_vector("vec"))
    got = tube.fit(df, c, epsilon)
    mine = objective(x, y, got.weights, got.bias, c, epsilon)
    w = by_coordinates(x, y, c, epsilon)
    other = min(objective(x, y, w, b, c, epsilon) for b in np.quantile(y - x @ w, np.linspace(0.2, 0.8, 400)))
    assert mine <= other * (1 + 2e-3)
    for _ in range(300):  # no neighbour is better
        near = objective(x, y, got.weights + rng.normal(0, 0.01, 3), got.bias + rng.normal(0, 0.01), c, epsilon)
        assert near > mine * (1 - 1e-4)
    out = df.withColumn("p", got.column()).toPandas()
    np.testing.assert_allclose(out["p"], np.stack(out["vec"]) @ got.weights + got.bias, atol=1e-9)


def test_points_inside_the_tube_have_no_influence(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = x @ np.array([2.0, 1.0]) + rng.normal(0, 1.0, 80)
    frame = lambda t: spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, t)], "vec array<double>, label double").withColumn("features", array_to_vector("vec"))
    first = tube.fit(frame(y), 1.0, 0.8)
    middle = x @ first.weights + first.bias
    inside = np.abs(y - middle) < 0.7
    assert inside.sum() > 20
    second = tube.fit(frame(np.where(inside, middle + (y - middle) * 0.5, y)), 1.0, 0.8)
    np.testing.assert_allclose([*second.weights, second.bias], [*first.weights, first.bias], atol=2e-3)


# ---- kernel maps --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["rbf", "poly", "sigmoid"])
def test_the_error_of_landmarks_falls_with_their_number(table, numbers, kind):
    errors = [kernels.fit_map({"kernel": kind, "gamma": "0.2", "degree": 3, "n_components": n}, table)[1] for n in (3, 12, 60)]
    if kind == "sigmoid":  # not a positive kernel: its negative part has no features, so an error stays
        assert errors[2] < min(0.35, errors[0])
    else:
        assert (errors[0] > errors[1] > errors[2] or errors[2] < 1e-6) and errors[2] < 0.05


def test_the_size_of_a_map_is_a_parameter(table):
    for params, size in (({"n_components": 17}, 17), ({"n_components": 40, "kernel_map": "fourier"}, 40)):
        apply, error = kernels.fit_map({"kernel": "rbf", "gamma": "auto", **params}, table)
        assert apply(table.limit(3)).select(F.size(F.expr("transform(array(1), i -> i)"))).count() == 3
        assert apply(table.limit(1)).first()["mapped"].size <= size and 0 <= error < 1
    with pytest.raises(ValueError):
        kernels.fit_map({"kernel": "poly", "kernel_map": "fourier"}, table)


def test_kernel_learners_use_the_map(table, numbers):
    flat = models.fit_regressor("SVR Non-Linear", {"C": 50.0, "epsilon": 0.1, "kernel": "rbf", "n_components": 60}, table).transform(table).select("label", "prediction").toPandas()
    assert 1 - ((flat["label"] - flat["prediction"]) ** 2).sum() / ((flat["label"] - flat["label"].mean()) ** 2).sum() > 0.8
