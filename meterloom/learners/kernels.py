"""Feature maps whose inner products stand for a kernel.

:func:`landmark_map` uses Nyström features: kernel values to a bounded sample of rows (landmarks), whitened by the kernel among the
landmarks. :func:`fourier_map` uses random Fourier features of the Gaussian kernel. Either has a size, and
:func:`kernel_error` measures how far its inner products are from the kernel on rows that were not landmarks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

SEED = 42
SIZE = 100
#: Rows that the error of a map is measured on.
CHECKED = 200

Map = Callable[[np.ndarray], np.ndarray]


def kernel(kind: str, gamma: float, degree: int = 3, shift: float = 0.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``rbf``, ``poly`` or ``sigmoid`` between the rows of two matrices."""
    if kind == "rbf":
        return lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0))
    if kind == "poly":
        return lambda a, b: (gamma * a @ b.T + shift) ** degree
    if kind == "sigmoid":
        return lambda a, b: np.tanh(gamma * a @ b.T + shift)
    raise ValueError(f"unknown kernel {kind!r}")


def some_rows(train: DataFrame, n: int, salt: int = SEED, features: str = "features") -> np.ndarray:
    """``n`` distinct rows (or all), the smallest by a hash of their content: the same ones in every run."""
    x = train.select(vector_to_array(features).alias("x")).distinct().withColumn("_h", F.xxhash64(F.lit(salt), "x"))
    total = max(1, x.count())
    share = (n + 10 * n**0.5 + 100) / total
    few = x if share >= 1 else x.filter(F.col("_h") < F.lit(int(-(2**63) + share * 2**64)))
    return np.array([r["x"] for r in few.orderBy("_h", "x").limit(n).collect()], float)  # at most ``n`` rows


def scale_gamma(train: DataFrame, params: Mapping, features: str = "features") -> float:
    """1 / (features x variance over all cells) for ``scale``, 1 / features for ``auto``, or the number itself."""
    choice = params.get("gamma", "scale")
    if choice not in ("scale", "auto"):
        return float(choice)
    stats = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).select("s.*").first()
    width, n = len(stats["mean"]), stats["count"]
    if choice == "auto":
        return 1.0 / width
    mean, var = stats["mean"].toArray(), stats["variance"].toArray() * max(n - 1, 1) / max(n, 1)
    overall = float((var + mean**2).mean() - mean.mean() ** 2)
    return 1.0 / (width * overall) if overall > 0 else 1.0


def landmark_map(landmarks: np.ndarray, k: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Map:
    """Directions in which the kernel among the landmarks is not positive are left out."""
    value, vector = np.linalg.eigh(k(landmarks, landmarks))
    good = value > max(value.max(initial=0.0), 0.0) * 1e-10
    white = vector[:, good] / np.sqrt(value[good])
    return lambda x: k(x, landmarks) @ white


def fourier_map(width: int, gamma: float, size: int = SIZE, seed: int = SEED) -> Map:
    """Random Fourier features of the Gaussian kernel exp(-gamma |x-y|^2)."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(scale=np.sqrt(2 * gamma), size=(width, size)), rng.uniform(0, 2 * np.pi, size=size)
    return lambda x: np.cos(x @ w + shift) * np.sqrt(2.0 / size)


def kernel_error(map_: Map, k: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: np.ndarray) -> float:
    """Relative distance (Frobenius) of the map's inner products from the kernel."""
    true, phi = k(rows, rows), map_(rows)
    return float(np.linalg.norm(phi @ phi.T - true) / max(np.linalg.norm(true), 1e-300))


def mapped(map_: Map, features: str = "features", target: str = "mapped") -> Callable[[DataFrame], DataFrame]:
    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(map_(np.stack(x.to_numpy()))) if len(x) else [])

    return lambda df: df.withColumn(target, array_to_vector(apply(vector_to_array(features))))


def fit_map(params: Mapping, train: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], float]:
    """The map that ``params`` ask for (``kernel, gamma, degree, coef0, n_components, kernel_map``) and its measured error."""
    gamma, size = scale_gamma(train, params), int(params.get("n_components", SIZE))
    k = kernel(str(params.get("kernel", "rbf")), gamma, int(params.get("degree", 3)), float(params.get("coef0", 0.0)))
    sample = some_rows(train, size)
    if params.get("kernel_map") == "fourier":
        if params.get("kernel", "rbf") != "rbf":
            raise ValueError("Fourier features stand for the Gaussian kernel only")
        map_ = fourier_map(sample.shape[1], gamma, size)
    else:
        map_ = landmark_map(sample, k)
    return mapped(map_), kernel_error(map_, k, some_rows(train, CHECKED, SEED + 1))
