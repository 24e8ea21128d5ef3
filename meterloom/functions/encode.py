"""Numeric encodings: cyclic calendar terms, Fourier terms, clipping, JSON parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from meterloom.functions.timeaxis import col

# Periods of the calendar encodings.
CYCLES = {"month": 12, "weekday": 7, "dayofyear": 365}


def cyclic_pair(value: str | Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * col(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def with_cyclic(df: DataFrame, keep_parts: bool = False) -> DataFrame:
    """Replace month, weekday and dayofyear by their sine and cosine."""
    new = {}
    for name, period in CYCLES.items():
        new[f"{name}_sin"], new[f"{name}_cos"] = cyclic_pair(name, period)
    out = df.withColumns(new)
    return out if keep_parts else out.drop(*CYCLES)


CYCLIC_COLUMNS = [f"{n}_{f}" for n in CYCLES for f in ("sin", "cos")]


def fourier_terms(index: str | Column, period: int, order: int) -> dict[str, Column]:
    """sin and cos of 2*pi*k*t/period for k = 1..order, with t a 0-based row index."""
    terms: dict[str, Column] = {}
    # The index is reduced modulo the period first, so the angle stays small and exact for long series.
    phase = (col(index) % F.lit(period)).cast("double")
    for k in range(1, order + 1):
        angle = F.lit(2.0 * math.pi * k / period) * phase
        terms[f"sin_{period}_{k}"] = F.sin(angle)
        terms[f"cos_{period}_{k}"] = F.cos(angle)
    return terms


def clip_at_zero(x: str | Column) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spark averages skip null but not NaN, so every ingest maps NaN to null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def params_to_json(params: str | Column) -> Column:
    return F.to_json(col(params))


def params_from_json(text: str | Column) -> Column:
    return F.from_json(col(text), "map<string,string>")


def strict_label(x: str | Column) -> Column:
    """Integer label; a null is an error, not a silent class."""
    c = col(x)
    return F.when(c.isNull(), F.raise_error(F.lit("null class label"))).otherwise(c.cast("int"))
