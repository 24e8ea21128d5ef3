"""Mixing sources to target weights by Poisson replication.

A source with weight w gets the rate ``w * total / size``: the mean number of times each of its documents is repeated.
The count of one document is the inverse of the Poisson distribution with that mean at a uniform number hashed from the
seed, the id and the source; a fraction of documents falls out where the rate is below one, and the expected size of each
source is exactly its weight. Counts depend on nothing but seed, id and source, so a recomputed task gives the same rows.
Each copy gets a hashed place in a global order and rows are dealt and sorted by it.

Size is code points plus one for each document, so a source of empty texts has a size too. Defined results: a null
source is a source of its own; null text counts as empty; rows that repeat an id get the same count each; an empty table
gives an empty result; further columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.tables import text_or_empty, whole_row
from meterloom.session import materialise

#: Means above this are drawn as a sum of several Poisson counts, as exp(-mean) gets too small.
MAX_MEAN = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, temperature: float = 0.5, weights: dict[str, float] | None = None,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, size, weight, rate`` per source.

    Weights are given by name (sources without one get 0) or, without ``weights``, are the sizes to the power of
    ``temperature``; either way they are scaled to sum to one. The sum of all sizes is kept by the mix.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(text_or_empty(text_col)) + F.lit(1)).alias("size"))
    if weights is None:
        raw = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, raw double")
        sizes = sizes.join(table, sizes["source"].eqNullSafe(table["named"]), "left").drop("named")
        raw = F.coalesce(F.col("raw"), F.lit(0.0))
    sizes = materialise(sizes.withColumn("raw", raw), "source_sizes")
    total = sizes.agg(F.sum("size").alias("size"), F.sum("raw").alias("raw")).first()  # one row
    weight = F.col("raw") / F.lit(total["raw"]) if total["raw"] else F.lit(0.0)
    return sizes.select("source", "size", weight.alias("weight"),
                        (weight * F.lit(float(total["size"] or 0)) / F.col("size")).alias("rate"))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of the mean ``rate / draws`` up to where doubles no longer grow."""
    mean = rate / F.ceil(F.greatest(rate / F.lit(MAX_MEAN), F.lit(1.0)))
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(96)), start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"),
                                F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"])


def replication(docs: DataFrame, rates: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` as ``row`` with its ``rate``, ``copies`` and id; no row is dropped yet."""
    table = rates.select(F.col("source").alias("of"), "rate", distribution(F.col("rate")).alias("cdf"),
                         F.ceil(F.greatest(F.col("rate") / F.lit(MAX_MEAN), F.lit(1.0))).cast("int").alias("draws"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), whole_row(docs).alias("row"))
    joined = rows.join(table, rows["source"].eqNullSafe(table["of"]))
    # Each draw is hashed once; the steps of the distribution below it are counted then.
    draws = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.lit(seed), F.col("id"), F.col("source"), j))
    copies = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("cdf", lambda c: (c <= u) & (c < F.element_at("cdf", -1)))))
    return joined.select("id", "source", "row", "rate", copies.alias("copies"))


def mix(docs: DataFrame, temperature: float = 0.5, weights: dict[str, float] | None = None, seed: int = 0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed corpus in shuffled order: ``row`` (all columns of ``docs``), ``id, source, rate, copies, copy, place``.

    ``copy`` counts from 0; ``place`` in [0, 1) is the global order. Read ``row.*`` for the documents alone.
    """
    # A stored table: its size on disk is known, so the planner broadcasts it only below its own threshold.
    rates = materialise(source_rates(docs, temperature, weights, source_col, text_col), "source_rates")
    counted = replication(docs, rates, seed, id_col, source_col).where("copies > 0")
    copies = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    placed = copies.withColumn("place", uniform(F.lit(seed), F.lit("place"), F.col("id"), F.col("source"), F.col("copy")))
    return placed.repartition("place").sortWithinPartitions("place")
