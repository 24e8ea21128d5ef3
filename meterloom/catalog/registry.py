"""Named queries with the SQL that must give the same rows.

Each entry lists its output columns once, with a code that fixes type and rounding on both sides:
``i`` integer, ``s`` text, ``d`` date as text, ``t`` stamp, a digit = double rounded to that many places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterloom.catalog import views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split():
        name, _, code = item.partition(":")
        out.append((name, code or "s"))
    return out


def _shape(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, code in _fields(spec):
        c = F.col(name)
        if code == "i":
            c = c.cast("bigint")
        elif code in ("s", "d"):
            c = c.cast("string")
        elif code == "t":
            c = c.cast("timestamp_ntz")
        else:
            r = F.round(c.cast("double"), int(code))
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        cols.append(c.alias(name))
    return df.select(*cols)


def _shape_sql(body: str, spec: str) -> str:
    cols = []
    for name, code in _fields(spec):
        if code == "i":
            e = f"CAST({name} AS BIGINT)"
        elif code in ("s", "d"):
            e = f"CAST({name} AS VARCHAR)"
        elif code == "t":
            e = f"CAST({name} AS TIMESTAMP)"
        else:
            r = f"round(CAST({name} AS DOUBLE), {code})"
            e = f"CASE WHEN {r} = 0 THEN 0.0 ELSE {r} END"
        cols.append(f"{e} AS {name}")
    return views.with_views(f"SELECT {', '.join(cols)} FROM ({body}) AS result")


def register(name: str, out: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``. Without ``sql`` it is checked by tests instead of a SQL twin."""

    def wrap(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, lambda spark, sf_dir: _shape(fn(spark, sf_dir), out), _shape_sql(sql, out) if sql else None)
        return fn

    return wrap
