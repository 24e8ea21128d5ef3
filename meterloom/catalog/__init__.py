"""Registered queries over the given tables."""

from __future__ import annotations


def load_entries():
    from meterloom.catalog import benchmarks, clusters, features, forecasts, models, plots, tables  # noqa: F401
    from meterloom.catalog.registry import ENTRIES

    return ENTRIES
