"""From the raw series to clustered days and their mean profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from meterloom.operators import clustering, codebook, intervals, reshape
from meterloom.operators.scale import min_max
from meterloom.session import materialise
from meterloom.sources.artefacts import write_keyed

KEYS = ["series_id", "variant"]
MODEL = ["series_id", "variant", "config_id", "k"]


@dataclass
class Shapes:
    """Interval profiles and slots are per day; labels and profiles carry ``k`` and ``config_id``."""

    slots: DataFrame
    interval_means: DataFrame
    vectors: DataFrame
    labels: DataFrame
    profiles: DataFrame


def shape_days(
    panel: DataFrame,
    ks: Sequence[int] = (2, 3),
    configs: Sequence[int] | None = None,
    variants: Sequence[str] = ("raw", "filter"),
    restarts: int = clustering.RESTARTS,
    labels: DataFrame | None = None,
) -> Shapes:
    """Scale, average per interval, cluster every (catalogue, k) and average the slots per cluster.

    ``panel`` holds ``series_id, ts, total, total_filter``. ``labels`` reuses stored labels instead of fitting.
    """
    long = reshape.as_variants(panel).filter(F.col("variant").isin(list(variants)))
    scaled = min_max(long, keys=KEYS)
    means = intervals.interval_means_wide(scaled, "scaled", KEYS, configs)
    vectors = intervals.interval_vectors(means, KEYS, configs)
    if labels is None:
        # The fits are run once and stored; everything below reads the stored labels.
        labels = materialise(clustering.cluster_days(vectors, ks, (*KEYS, "config_id"), restarts), "labels")
    slots = reshape.day_slots(scaled, "scaled", KEYS)
    profiles = clustering.mean_profiles(clustering.attach_labels(slots, labels.drop("inertia"), KEYS), MODEL)
    return Shapes(slots, means, vectors, labels, profiles)


def shape_days_per_fold(panel: DataFrame, folded: DataFrame, ks: Sequence[int] = (2, 3), configs: Sequence[int] | None = None, restarts: int = clustering.RESTARTS) -> Shapes:
    """Shapes from each fold's training days alone: scaling, clusters and profiles never see a test day.

    ``folded``: series_id, variant, date, fold, role. All tables carry ``fold``; cluster numbers are matched over the folds of a series,
    so a number means the same shape in each.
    """
    keys = [*KEYS, "fold"]
    days = folded.filter("role = 'train'").select(*keys, "date").distinct()
    long = reshape.as_variants(panel).withColumn("date", F.to_date("ts")).join(days, [*KEYS, "date"])
    scaled = min_max(long, keys=keys)
    means = intervals.interval_means_wide(scaled, "scaled", keys, configs)
    vectors = intervals.interval_vectors(means, keys, configs)
    fitted = materialise(clustering.cluster_days(vectors, ks, (*keys, "config_id"), restarts), "fold-labels")
    slots = reshape.day_slots(scaled, "scaled", keys)
    model = ["fold", *MODEL]
    own = clustering.mean_profiles(clustering.attach_labels(slots, fitted.drop("inertia"), keys), model)
    codes = codebook.align_codebook(own, MODEL, ["fold"])
    labels = materialise(codebook.renumber(fitted, codes, model), "labels")
    return Shapes(slots, means, vectors, labels, codebook.renumber(own, codes, model))


def write_shapes(shapes: Shapes, root: str) -> dict[str, str]:
    """The three stage tables, partitioned by setting: interval profiles with label, day slots with label, mean profiles."""
    labels = shapes.labels.drop("inertia")
    by_interval = shapes.vectors.join(labels, [*KEYS, "config_id", "date"])
    by_slot = clustering.attach_labels(shapes.slots, labels, KEYS)
    return {
        "interval_profiles": write_keyed(by_interval, f"{root}/interval_profiles"),
        "slot_profiles": write_keyed(by_slot, f"{root}/slot_profiles"),
        "mean_profiles": write_keyed(shapes.profiles, f"{root}/mean_profiles"),
    }
