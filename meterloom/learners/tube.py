"""Support vector regression: half the squared weights plus C times the summed distance of the residuals to a tube of half-width
epsilon.

The loss has corners, so it is rounded over a width delta: quadratic from the edge of the tube to delta beyond it, straight from
there on, and exactly 0 inside. Newton steps with halving solve the rounded problem, for a delta that shrinks to
:data:`LAST` of the scale of the label. A pass over the rows tries all halvings of a step at once: tasks add up loss, gradient and curvature, Spark sums those
over the tasks, and only the sums, whose size depends on the number of features, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from meterloom.session import materialise

FIRST, LAST, SHRINK = 1.0, 1e-4, 0.3
STEPS, HALVINGS = 60, 24


@dataclass
class TubeModel:
    weights: np.ndarray
    bias: float
    objective: float

    def column(self, features: str = "features") -> Column:
        x = vector_to_array(features)
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.bias)), lambda s, v: s + v)


def rounded(excess: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature of the distance beyond the tube."""
    inside, straight = excess <= 0, excess >= delta
    loss = np.where(inside, 0.0, np.where(straight, excess - delta / 2, excess * excess / (2 * delta)))
    slope = np.where(inside, 0.0, np.where(straight, 1.0, excess / delta))
    return loss, slope, np.where(inside | straight, 0.0, 1.0 / delta)


def sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, epsilon: float, delta: float) -> np.ndarray:
    """Loss, gradient and the upper triangle of the curvature, by weights and bias."""
    z = np.c_[x, np.ones(len(x))]
    r = y - z @ at
    loss, slope, curve = rounded(np.abs(r) - epsilon, delta)
    h = (z * curve[:, None]).T @ z
    return np.r_[loss.sum(), -(slope * np.sign(r)) @ z, h[np.triu_indices(z.shape[1])]]


def _pass(stored: DataFrame, width: int, points: list[np.ndarray], epsilon: float, delta: float) -> np.ndarray:
    """:func:`sums` at the first point, followed by the loss at each other point."""
    size = 1 + width + 1 + (width + 1) * (width + 2) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + len(points) - 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                some = batch.slice(lo, 8192)
                x, y = np.asarray(some.column(0).flatten()).reshape(len(some), width), np.asarray(some.column(1))
                total[:size] += sums(x, y, points[0], epsilon, delta)
                for i, p in enumerate(points[1:]):
                    total[size + i] += rounded(np.abs(y - x @ p[:-1] - p[-1]) - epsilon, delta)[0].sum()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["i", "v"])

    out = np.zeros(size + len(points) - 1)
    for row in stored.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as sums
        out[row["i"]] = row["v"]
    return out


def fit(train: DataFrame, c: float = 1.0, epsilon: float = 0.1, features: str = "features", label: str = "label") -> TubeModel:
    rows = train.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).dropna()
    stats = rows.agg(F.max(F.size("x")).alias("width"), F.percentile_approx("y", 0.5).alias("middle"), F.stddev_pop("y").alias("sd")).first()
    if stats["width"] is None:
        raise ValueError("no rows to learn from")
    width, scale = stats["width"], max(epsilon, stats["sd"] or 0.0, 1e-9)
    stored = materialise(rows, "tube-rows")
    at = np.r_[np.zeros(width), stats["middle"]]
    ridge = np.r_[np.ones(width), 0.0]
    upper = np.triu_indices(width + 1)

    def evaluate(points: list[np.ndarray], delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Objective at all points, gradient and curvature at the first."""
        s, first = _pass(stored, width, points, epsilon, delta), points[0]
        h = np.zeros((width + 1, width + 1))
        end = width + 2 + len(upper[0])
        h[upper] = s[width + 2 : end]
        h = h + np.triu(h, 1).T
        value = np.array([0.5 * (ridge * p) @ p for p in points]) + c * np.r_[s[0], s[end:]]
        return value, ridge * first + c * s[1 : width + 2], np.diag(ridge) + c * h

    delta = FIRST * scale
    while True:
        values, gradient, curve = evaluate([at], delta)
        for _ in range(STEPS):
            if np.abs(gradient).max() <= 1e-8 * max(1.0, c):
                break
            curve[-1, -1] += 1e-9 * max(1.0, c)
            step, value = -np.linalg.solve(curve, gradient), values[0]
            down, sizes = gradient @ step, 0.5 ** np.arange(HALVINGS)
            values, gradient, curve = evaluate([at + t * step for t in sizes], delta)
            good = np.flatnonzero(values <= value + 1e-4 * sizes * down)
            if not len(good):
                values = np.array([value])
                break
            at = at + sizes[good[0]] * step
            if value - values[good[0]] <= 1e-12 * max(1.0, abs(value)):
                values = values[good[:1]]
                break
            if good[0]:
                values, gradient, curve = evaluate([at], delta)
        if delta <= LAST * scale:
            return TubeModel(at[:-1], float(at[-1]), float(values[0]))
        delta *= SHRINK
