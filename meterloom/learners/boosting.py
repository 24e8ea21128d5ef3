"""Gradient-boosted trees from binned histograms, one pass over the rows per level.

Features are cut into bins at their quantiles once, and rows are stored as blocks of bin numbers, labels and margins. For each
level of a tree every task adds up gradient, hessian and rows by (class, node, feature, bin); Spark sums those histograms, running
sums over the bins give the second-order gain of each cut, and only the best cut of each node and feature reaches the driver.
A node's best cut does not depend on other nodes, so a tree that grows leaf by leaf, always at the largest gain, is found level by
level: a level only looks at nodes that are still within the leaf limit in order of gain. The trees of all classes grow in the same
passes. Margins are stored every :data:`STORE` trees; between, the few new trees are added while the blocks are read.

Options are those of the usual boosting families: shrinkage, depth, leaf limit, least hessian and rows of a child, least gain, L1
and L2 on leaf values, row and column sampling, number of bins, and trees that use one cut for a whole level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.session import materialise

SEED = 42
BLOCK, STORE = 8192, 10


@dataclass(frozen=True)
class Options:
    rounds: int = 50
    rate: float = 0.1
    depth: int = 6
    leaves: int | None = None
    child_weight: float = 1e-3
    child_rows: int = 1
    gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 256
    level_cuts: bool = False
    seed: int = SEED


def options(family: str, params: Mapping) -> Options:
    """Options from the parameter names of a boosting family."""
    def get(names: str, kind, default):
        for n in names.split():
            if n in params:
                return kind(params[n])
        return default

    out = Options(
        rounds=get("n_estimators iterations", int, 50), rate=get("learning_rate", float, 0.1), depth=get("max_depth depth", int, 6),
        rows=get("subsample", float, 1.0), columns=get("colsample_bytree", float, 1.0), l1=get("reg_alpha", float, 0.0), gain=get("gamma", float, 0.0))
    if family == "XGBoost":
        return replace(out, child_weight=get("min_child_weight", float, 1.0), l2=get("reg_lambda", float, 1.0))
    if family == "LightGBM":
        return replace(out, leaves=get("num_leaves", int, 31), child_rows=get("min_child_samples", int, 20), l2=get("reg_lambda", float, 0.0), bins=255)
    return replace(out, l2=get("l2_leaf_reg", float, 3.0), bins=get("border_count", int, 254), level_cuts=True)


@dataclass
class Tree:
    """Nodes in the order they were made; node 0 is the root. A leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.value, value), (self.gain, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row; ``bins`` is features by rows."""
        feature, cut, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(bins.shape[1], np.int64)
        row = np.arange(bins.shape[1])
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[np.where(inner, f, 0), row] > cut[at]
            at = np.where(inner, left[at] + right, at)

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(bins)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Features by rows: the first cut that is not below the value."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]).astype(np.int64)


def _gradients(margin: np.ndarray, label: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian, rows by trees of a round. 0 classes: squared error; 2: logistic; more: softmax."""
    if classes == 0:
        return margin - label[:, None], np.ones_like(margin)
    if classes == 2:
        p = 1 / (1 + np.exp(-margin))
        return p - label[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(margin - margin.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (label[:, None] == np.arange(classes)), np.maximum(2 * p * (1 - p), 1e-16)


def _soft(g, l1: float):
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(l1), F.lit(0.0))


def _leaf_value(g: float, h: float, o: Options) -> float:
    return -o.rate * math.copysign(max(abs(g) - o.l1, 0.0), g) / (h + o.l2) if h + o.l2 > 0 else 0.0


def best_cuts(histograms: DataFrame, o: Options) -> DataFrame:
    """``tree, node, gain, feature, bin`` of the best cut of every node and feature (with ``level_cuts``: of every node) with the sums
    ``gl, hl, g, h`` on its left and in all.

    ``histograms``: tree, node, feature, bin, g, h, n, already added up by each task. One shuffle deals them by node and feature, and
    everything up to the best bin happens where they arrive.
    """
    summed = histograms.repartition("tree", "node", "feature").groupBy("tree", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    own = Window.partitionBy("tree", "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    walked = summed.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in "ghn"], *[F.sum(c).over(own).alias(c) for c in "ghn"])
    value = lambda g, h: F.try_divide(_soft(g, o.l1) * _soft(g, o.l1), h + F.lit(o.l2))
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = (value(F.col("gl"), F.col("hl")) + value(gr, hr) - value(F.col("g"), F.col("h"))) / 2.0 - F.lit(o.gain)
    sound = (F.col("hl") >= o.child_weight) & (hr >= o.child_weight) & (F.col("nl") >= o.child_rows) & (F.col("n") - F.col("nl") >= o.child_rows)
    # Sums of doubles come in any order; equal gains must not be told apart by their last digits.
    rated = walked.withColumn("gain", F.when(sound, F.round(gain, 10)))
    if o.level_cuts:  # one cut for all nodes of a level: the gains of its nodes add up
        level = rated.groupBy("tree", "feature", "bin").agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("_sum"))
        one = level.groupBy("tree").agg(F.max(F.struct("_sum", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("_one"))
        joined = rated.join(one, "tree").filter((F.col("feature") == -F.col("_one.f")) & (F.col("bin") <= -F.col("_one.b")) & (F.col("_one._sum") > 0))
        best = joined.groupBy("tree", "node").agg(F.max_by(F.struct(F.coalesce("gain", F.lit(0.0)).alias("gain"), "feature", (-F.col("_one.b")).alias("bin"), "gl", "hl", "g", "h"), "bin").alias("s"))
        return best.select("tree", "node", "s.*")
    place = F.struct("gain", (-F.col("bin")).alias("b"))
    best = rated.filter("gain > 0").groupBy("tree", "node", "feature").agg(F.max_by(F.struct("gain", "bin", "gl", "hl", "g", "h"), place).alias("s"))
    return best.select("tree", "node", "feature", "s.*")


@dataclass
class Boosted:
    """Cut points per feature, start margins and trees by round and class."""

    cuts: list[np.ndarray]
    start: np.ndarray
    classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.cuts), np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.score(bins)
        return out

    def margin_column(self, features: str = "features") -> Column:
        """The margins of a vector column, as an array."""
        model = self

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.margins(np.stack(x.to_numpy()))) if len(x) else [])

        return score(vector_to_array(features))


def _cut_points(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Quantiles of every feature; all its values where they are few."""
    names = [f"x{i}" for i in range(width)]
    wide = rows.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    found = wide.approxQuantile(names, [(i + 1) / bins for i in range(bins)], 0.1 / bins)
    return [np.unique(np.array(q, float)) for q in found]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], start: np.ndarray) -> DataFrame:
    """``block, n, bins, label, margin``: rows as matrices of at most :data:`BLOCK` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                x = np.asarray(some.column(0).flatten()).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([len(some)], pa.int32()), pa.array([binned(x, cuts).astype("<u2").tobytes()], pa.binary()),
                     pa.array([np.asarray(some.column(1)).astype("<f8").tobytes()], pa.binary()), pa.array([np.tile(start, (len(some), 1)).astype("<f8").tobytes()], pa.binary())],
                    ["block", "n", "bins", "label", "margin"])
                number += 1

    return rows.mapInArrow(run, "block long, n int, bins binary, label binary, margin binary")


def _read(batch: pa.RecordBatch, i: int, width: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    block, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
    bins = np.frombuffer(batch.column(2)[i].as_py(), "<u2").reshape(width, n).astype(np.int64)
    return block, bins, np.frombuffer(batch.column(3)[i].as_py(), "<f8"), np.frombuffer(batch.column(4)[i].as_py(), "<f8").reshape(n, -1).copy()


def _histograms(stored: DataFrame, width: int, classes: int, pending: list[list[Tree]], trees: list[Tree], active: list[list[int]], columns: list[int], bins: int, number: int, o: Options) -> DataFrame:
    """Sums by (tree, node, feature, bin) over the rows that the active nodes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(a), len(columns), bins, 3)) for a in active]
        for batch in batches:
            for i in range(batch.num_rows):
                block, x, label, margin = _read(batch, i, width)
                for earlier in pending:
                    for k, tree in enumerate(earlier):
                        margin[:, k] += tree.score(x)
                g, h = _gradients(margin, label, classes)
                taken = np.random.default_rng([o.seed, number, block]).random(x.shape[1]) < o.rows if o.rows < 1 else np.ones(x.shape[1], bool)
                for k, tree in enumerate(trees):
                    local = np.full(len(tree.feature), -1)
                    local[active[k]] = np.arange(len(active[k]))
                    node = local[tree.place(x)]
                    own = np.flatnonzero((node >= 0) & taken)
                    if not len(own):
                        continue
                    for c, f in enumerate(columns):
                        cell = node[own] * bins + x[f, own]
                        for s, w in enumerate((g[own, k], h[own, k], None)):
                            sums[k][:, c, :, s] += np.bincount(cell, w, len(active[k]) * bins).reshape(-1, bins)
        parts = [(np.full(len(at), k), np.array(active[k])[at[:, 0]], np.array(columns)[at[:, 1]], at[:, 2], s[tuple(at.T)]) for k, s in enumerate(sums) for at in (np.argwhere(s[..., 2] > 0),) if len(at)]
        tree, node, feature, cut, value = (np.concatenate([p[j] for p in parts]) for j in range(5)) if parts else (np.zeros(0, int),) * 4 + (np.zeros((0, 3)),)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(a.astype(np.int32)) for a in (tree, node, feature, cut)], *[pa.array(np.ascontiguousarray(value[:, s])) for s in range(3)]], ["tree", "node", "feature", "bin", "g", "h", "n"])

    return stored.mapInArrow(run, "tree int, node int, feature int, bin int, g double, h double, n double")


def _with_margins(stored: DataFrame, width: int, pending: list[list[Tree]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                _, x, _, margin = _read(batch, i, width)
                for earlier in pending:
                    for k, tree in enumerate(earlier):
                        margin[:, k] += tree.score(x)
                out.append(margin.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["block", "n", "bins", "label", "margin"])

    return materialise(stored.mapInArrow(run, "block long, n int, bins binary, label binary, margin binary"), "margins")


def _within_leaves(tree: Tree, found: dict[int, tuple], limit: int | None) -> list[int]:
    """The nodes that are cut when the largest gain always goes first, up to a number of leaves."""
    picked, open_nodes = [], [0]
    while open_nodes and (limit is None or len(picked) < limit - 1):
        best = max((n for n in open_nodes if n in found), key=lambda n: (found[n][0], -n), default=None)
        if best is None:
            break
        picked.append(best)
        open_nodes.remove(best)
        if tree.left[best] >= 0:
            open_nodes += [tree.left[best], tree.left[best] + 1]
    return picked


def _grow(stored: DataFrame, width: int, classes: int, pending: list[list[Tree]], count: int, columns: list[int], bins: int, number: int, o: Options) -> list[Tree]:
    """The trees of one round, level by level."""
    trees, found = [Tree() for _ in range(count)], [dict() for _ in range(count)]
    active = [[0] for _ in range(count)]
    for _ in range(o.depth):
        if not any(active):
            break
        cuts = best_cuts(_histograms(stored, width, classes, pending, trees, active, columns, bins, number, o), o).collect()  # one row per node and feature
        best: dict = {}
        for r in cuts:
            own = best.get((r["tree"], r["node"]))
            if own is None or (r["gain"], -r["feature"]) > (own["gain"], -own["feature"]):
                best[r["tree"], r["node"]] = r
        rows = list(best.values())
        for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
            tree, node = trees[r["tree"]], r["node"]
            found[r["tree"]][node] = (r["gain"],)
            if node == 0:
                tree.value[0] = _leaf_value(r["g"], r["h"], o)
            tree.feature[node], tree.bin[node], tree.gain[node] = r["feature"], r["bin"], r["gain"]
            tree.left[node] = tree.add(_leaf_value(r["gl"], r["hl"], o))
            tree.add(_leaf_value(r["g"] - r["gl"], r["h"] - r["hl"], o))
        for k, tree in enumerate(trees):
            picked = set(_within_leaves(tree, found[k], o.leaves))
            fresh = {r["node"] for r in rows if r["tree"] == k}
            active[k] = [c for n in sorted(picked & fresh) for c in (tree.left[n], tree.left[n] + 1)]
    for k, tree in enumerate(trees):
        picked = set(_within_leaves(tree, found[k], o.leaves))
        for n in range(len(tree.feature)):
            if n not in picked:
                tree.feature[n] = -1  # beyond the leaf limit: a leaf
    return trees


def fit(train: DataFrame, o: Options, classes: int = 0, features: str = "features", label: str = "label") -> Boosted:
    """Boosted trees for a number (``classes`` = 0) or for labels 0 .. classes-1."""
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).dropna()
    stats = rows.agg(F.max(F.size("x")).alias("width"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")).first()
    if not stats["n"]:
        raise ValueError("no rows to learn from")
    width = stats["width"]
    cuts = _cut_points(rows, width, o.bins)
    count = classes if classes > 2 else 1
    if classes == 0:
        start = np.array([stats["mean"]])
    elif classes == 2:
        p = min(max(stats["mean"], 1e-6), 1 - 1e-6)
        start = np.array([math.log(p / (1 - p))])
    else:
        start = np.zeros(classes)
    model = Boosted(cuts, start, classes)
    bins = max(len(c) for c in cuts) + 1
    stored = materialise(_blocks(rows, cuts, start), "binned")
    pending: list[list[Tree]] = []
    for number in range(o.rounds):
        rng = np.random.default_rng([o.seed, number])
        some = sorted(rng.choice(width, max(1, math.ceil(o.columns * width)), replace=False).tolist()) if o.columns < 1 else list(range(width))
        trees = _grow(stored, width, classes, pending, count, some, bins, number, o)
        if o.rows >= 1 and o.columns >= 1 and all(t.feature[0] < 0 for t in trees):
            break  # no cut has a gain, and none will have later
        model.rounds.append(trees)
        pending.append(trees)
        if len(pending) == STORE and number + 1 < o.rounds:
            stored, pending = _with_margins(stored, width, pending), []
    return model
