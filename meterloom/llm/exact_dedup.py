"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input forms one run: its distinct digests in order, each with the smallest id seen and a row count. Runs
meet in binomial rounds: in each round ``2**fan_bits`` neighbouring runs merge into one. A round is a sort aggregate: rows are sorted
by (run, digest), dealt by (run, digest), and equal neighbours of all merged runs fold into one entry, which keeps the smallest id
and the sum of the counts. Its output stands in the order of run and digest, as the smallest id is a struct, which Spark never
folds in a hash table. A digest is held by at most one row per run, so a group of copies shrinks by the fan-in in every round
and never meets in one task; the partial entries of the first round are made before anything is shuffled. Entries are only
merged where SHA-256, a second 64-bit hash and the length all agree.

Defined results: null text counts as empty; a null id is never smaller than another id and is kept only where all ids
of the group are null; rows that repeat an id and a text form one document (all such rows are marked alike,
:func:`deduplicate` returns one of them); an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.tables import text_or_empty, whole_row
from meterloom.session import materialise

SPACE_RUN = r"[\x20\x09-\x0D]+"
RUNS = 4096
KEY = ("digest", "mark", "size")


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: bool = False) -> DataFrame:
    """``id, digest, mark, size`` per row, and the row itself as ``row`` if ``payload``."""
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ").alias("plain"),
                       *([whole_row(docs).alias("row")] if payload else []))
    return rows.select("id", F.unhex(F.sha2("plain", 256)).alias("digest"), F.xxhash64("plain").alias("mark"),
                       F.octet_length("plain").alias("size"), *(["row"] if payload else []))


def merge_runs(digests: DataFrame, runs: int = RUNS, fan_bits: int = 4) -> DataFrame:
    """One row per distinct text, in the order of the digest inside each partition: ``digest, mark, size, keep_id, group_size``.

    ``digests`` has a ``run`` number below ``runs`` (a power of two) for each row.
    """
    # Null ids stand behind all others.
    level = digests.select("run", *KEY, F.struct(F.col("id").isNull().alias("none"), "id").alias("least"), F.lit(1).cast("long").alias("group_size"))
    left = (runs - 1).bit_length()
    while left > 0:
        step = min(fan_bits, left)
        left -= step
        merged = level.withColumn("run", F.shiftright("run", step)).groupBy("run", *KEY)
        level = merged.agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size"))
    return level.select(*KEY, F.col("least.id").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_bits: int = 4) -> DataFrame:
    """Per row: ``id_col, keep_id, group_size, kept, text_sha256``. Texts are equal up to runs of ASCII white space."""
    numbered = with_digest(docs, id_col, text_col).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
    digests = materialise(numbered, "digests")
    winners = merge_runs(digests, runs, fan_bits)
    return digests.join(winners, list(KEY)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fan_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with their own columns."""
    digests = with_digest(docs, id_col, text_col).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
    winners = materialise(merge_runs(digests, runs, fan_bits), "winners")
    rows = with_digest(docs, id_col, text_col, payload=True)
    kept = rows.join(winners, list(KEY)).where(F.col("id").eqNullSafe(F.col("keep_id")))
    if not docs.groupBy(id_col).count().where("count > 1").isEmpty():  # rows that repeat an id and a text are one document
        kept = kept.dropDuplicates([*KEY, "id"])
    return kept.select("row.*")
