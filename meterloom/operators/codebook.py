"""One numbering of clusters over many models.

Each model numbers its clusters on its own. :func:`align_codebook` gives the models of a group (for example all series under one
setting, or all folds of a series) a common codebook of shapes: clusters of a model are assigned to different codes so that the
summed squared distance of their profiles to the codewords is least, codewords move to the mean of their profiles, and both
repeat until no assignment changes. Profiles are divided by the mean level of their model first, so meters of unlike size meet by
shape.

A model is one row with k profiles; assignments run on partitions of models, and only the codewords (group x code) reach the
driver, whose number does not grow with the series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from meterloom.session import materialise

ROUNDS = 20


def least_assignment(cost: np.ndarray) -> np.ndarray:
    """For each row a different column, at the least total cost (rows <= columns): shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            closer = reduced < least[free]
            least[free[closer]], back[free[closer]] = reduced[closer], j0
            j1 = free[np.argmin(least[free])]
            step = least[j1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[back[j0]]
            j0 = back[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def profile_vectors(profiles: DataFrame, group: Sequence[str], model: Sequence[str]) -> DataFrame:
    """``group, model, clusters``: one row per model with ``(cluster, vec)`` in order of the clusters.

    ``profiles`` is long (cluster, slot, value). Vectors cover the slots of the group; a missing slot has the mean of the
    profile. All are divided by the model's mean level.
    """
    keys = [*group, *model]
    spans = profiles.groupBy(*group).agg(F.array_sort(F.collect_set("slot")).alias("_slots"))  # one entry per time of day
    own = profiles.groupBy(*keys, "cluster").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_map"), F.avg("value").alias("_mean"))
    vec = F.transform("_slots", lambda s: F.coalesce(F.try_element_at("_map", s), F.col("_mean"), F.lit(0.0)))
    dense = own.join(spans, list(group)).select(*keys, "cluster", vec.alias("vec"), "_mean")
    rows = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cluster", "vec"))).alias("clusters"), F.avg("_mean").alias("_level"))
    level = F.when(F.abs(F.col("_level")) > 0, F.col("_level")).otherwise(F.lit(1.0))
    return rows.select(*keys, F.transform("clusters", lambda c: F.struct(c["cluster"].alias("cluster"), F.transform(c["vec"], lambda x: x / level).alias("vec"))).alias("clusters"))


def align_codebook(profiles: DataFrame, group: Sequence[str] = ("variant", "k", "config_id"), model: Sequence[str] = ("series_id",), rounds: int = ROUNDS) -> DataFrame:
    """``group, model, cluster, code``: the common number of every cluster. Codes of a model are different."""
    group, model = list(group), list(model)
    keys = [*group, *model]
    stored = materialise(profile_vectors(profiles, group, model), "profile-vectors")
    fields = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys)

    def assigned(words: dict):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for row in b.itertuples(index=False):
                    place = tuple(getattr(row, k) for k in keys)
                    x = np.stack([np.asarray(c["vec"], float) for c in row.clusters])
                    names = [c["cluster"] for c in row.clusters]
                    book = words.get(place[: len(group)])
                    codes = names if book is None else least_assignment(((x[:, None, :] - book[None]) ** 2).sum(2))
                    out += [(*place, int(c), int(code), v) for c, code, v in zip(names, codes, x)]
                if out:
                    yield pd.DataFrame(out, columns=[*keys, "cluster", "code", "vec"])

        return stored.mapInPandas(run, f"{schema}, cluster int, code int, vec array<double>")

    def moved(rows: DataFrame) -> dict:
        """The mean profile of every code: group x code rows."""
        cells = rows.select(*group, "code", F.posexplode("vec").alias("i", "x")).groupBy(*group, "code", "i").agg(F.avg("x").alias("x"))
        found = cells.groupBy(*group, "code").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("w")).collect()
        books: dict = {}
        for r in sorted(found, key=lambda r: r["code"]):
            books.setdefault(tuple(r[k] for k in group), []).append([p["x"] for p in r["w"]])
        return {g: np.array(w) for g, w in books.items()}

    words = moved(assigned({}))  # cluster numbers to begin with: models number by rising mean
    for _ in range(rounds):
        again = moved(assigned(words))
        settled = all(again[g].shape == w.shape and np.allclose(again[g], w, rtol=0, atol=1e-12) for g, w in words.items())
        words = again if not settled else words
        if settled:
            break
    return materialise(assigned(words).drop("vec"), "codes")


def renumber(labels: DataFrame, codes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels by their common number."""
    return labels.join(codes.select(*keys, "cluster", "code"), [*keys, "cluster"]).withColumn("cluster", F.col("code")).drop("code")
