"""Near-duplicate documents by one-permutation MinHash, with links confirmed on whole shingle sets.

1. One pass hashes the word shingles of a text once (one permutation), takes the least value in each of :data:`BINS` ranges and
   fills empty ranges from others by optimal densification: each empty range asks the ranges in an order of its own and takes
   the first that has a value, so every range agrees with the probability of the Jaccard similarity. Ranges in groups of
   :data:`ROWS` make ``BINS / ROWS`` bucket keys; a pair at the threshold of 0.8 is missed with probability 5e-8.
2. Documents of equal sets are one node, their smallest id.
3. Each bucket gives a star: an edge from every member to its centre, so a bucket of n nodes has n - 1 edges. The centre is the
   member with the most bucket mates in all its bands, as the origin of a family of copies is, not a copy far from it.
   Edges are confirmed on the full sets of both texts.
4. Members that share a centre but are in different components after that are compared with each other, so no link is lost
   to the star shape: those outside the largest component of their centre against all, in cells of about :data:`CELL` by
   :data:`CELL` texts. A cell gives links alone; pairs are counted by a product of set matrices and never become rows.
5. Components of the confirmed edges.

Words are runs of other bytes than ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. Shingles are compared as 64-bit hashes. A text of
fewer words than a shingle has its whole sequence as one; a text without words has an empty set, no link and is kept.
Rows with a null id are given back unlinked and kept; ids name documents, so rows that repeat an id with the same text share
one result. An empty table gives an empty result and further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.byte_words import U64, Words, blocks, mix64
from meterloom.llm.components import connected_components
from meterloom.llm.tables import whole_row
from meterloom.session import materialise

BINS, ROWS = 128, 4
CELL = 128


def densification_order(bins: int = BINS) -> np.ndarray:
    """For each range the order in which it asks the others."""
    return np.argsort(np.random.RandomState(11).rand(bins, bins), axis=1)


def signature(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One value per range from sorted distinct 64-bit hashes (at least one)."""
    bins = len(order)
    shift = U64(64 - (bins - 1).bit_length())
    edges = np.arange(bins, dtype=U64) << shift
    at = np.searchsorted(values, edges)
    found = values[np.minimum(at, len(values) - 1)]
    full = (at < len(values)) & ((found >> shift) == np.arange(bins, dtype=U64))
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = order[empty]
        found[empty] = found[asked[np.arange(len(empty)), full[asked].argmax(1)]]
    return found


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each group of ranges; the group's number is part of it."""
    parts = sig.reshape(-1, rows)
    key = mix64(np.arange(len(parts), dtype=U64) + U64(1))
    for j in range(rows):
        key = mix64(key * U64(0x9FB21C651E98DF25) + parts[:, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """``id, n_shingles, set_key`` (hash of the whole set) and ``bands`` (null for an empty set); text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = densification_order(bins)
        for batch in batches:
            for a, b, data, limits in blocks(batch.column(1)):
                value, first = Words(data, limits, lower=True).shingles(k)
                n, key, bands = [], [], []
                for x, y in zip(first[:-1], first[1:]):
                    own = np.unique(value[x:y])
                    n.append(len(own))
                    key.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(signature(own, order), rows) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["id", "n_shingles", "set_key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n_shingles long, set_key binary, bands array<long>")


def confirmed(edges: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The edges ``a, b`` whose sets have ``100 * intersection >= percent * union``."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ends = materialise(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")
    needed = materialise(text.join(ends, "id", "left_semi"), "texts")
    pairs = edges.join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(texts: pa.Array) -> list[np.ndarray]:
            coded = texts.dictionary_encode()
            out = []
            for _, _, data, limits in blocks(coded.dictionary):
                value, first = Words(data, limits, lower=True).shingles(k)
                out += [np.unique(value[x:y]) for x, y in zip(first[:-1], first[1:])]
            return [out[i] for i in coded.indices.to_pylist()]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                keep = []
                for s, t in zip(sets(some.column(2).fill_null("")), sets(some.column(3).fill_null(""))):
                    both = len(s) + len(t)
                    common = both - len(np.unique(np.r_[s, t])) if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) else 0
                    keep.append(common > 0 and 100 * common >= percent * (both - common))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def star_edges(nodes: DataFrame) -> DataFrame:
    """``a, b``: every node and each centre of its buckets, from ``node, bands``."""
    in_bucket = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(in_bucket.join(shared, "bucket"), "buckets")
    mates = members.groupBy("node").agg(F.sum("n").alias("mates"))
    centres = members.join(mates, "node").groupBy("bucket").agg(F.max_by("node", F.struct("mates", -F.col("node"))).alias("b"))
    return members.select("bucket", F.col("node").alias("a")).join(centres, "bucket").where("a <> b").select("a", "b").distinct()


def cell_links(first: list[np.ndarray], second: list[np.ndarray], allowed: np.ndarray, percent: int, width: int = 4096) -> np.ndarray:
    """Pairs ``(i, j)`` of two lists of sets that are allowed and similar enough; intersections by a product of 0/1 matrices."""
    size = [np.array([len(s) for s in x]) for x in (first, second)]
    least, most = np.minimum.outer(*size), np.maximum.outer(*size)
    allowed = allowed & (100 * least >= percent * most)
    rows, columns = np.flatnonzero(allowed.any(1)), np.flatnonzero(allowed.any(0))
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    x, y = [first[i] for i in rows], [second[j] for j in columns]
    value, at = np.unique(np.concatenate(x + y), return_inverse=True)
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, len(value), width):
        lo, hi = np.searchsorted(at, (start, start + width))
        dense = np.zeros((len(x) + len(y), width), np.float32)
        dense[owner[lo:hi], at[lo:hi] - start] = 1
        common += dense[: len(x)] @ dense[len(x) :].T
    n = common.astype(np.int64)
    union = np.add.outer(size[0][rows], size[1][columns]) - n
    i, j = np.nonzero(allowed[np.ix_(rows, columns)] & (n > 0) & (100 * n >= percent * union))
    return np.stack([rows[i], columns[j]], 1)


def rest_links(edges: DataFrame, parts: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a, b`` between nodes that share a centre (``edges``: node, centre) and are in different components of ``parts``."""
    placed = materialise(edges.withColumnRenamed("a", "node").join(parts, "node", "left").select(
        "node", F.col("b").alias("centre"), F.coalesce("component", "node").alias("component")), "placed")
    sizes = placed.groupBy("centre", "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("centre").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.max_by("component", F.struct("n", "component")).alias("main"))
    groups = materialise(groups.where("all > top").select(
        "centre", "main", F.ceil(F.col("all") / CELL).cast("int").alias("columns"), F.ceil((F.col("all") - F.col("top")) / CELL).cast("int").alias("rows")), "groups")
    members = placed.join(groups, "centre")
    lot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = members.where("component <> main").select("centre", lot("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), F.lit(True).alias("row"), "node", "component")
    right = members.select("centre", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), lot("columns").alias("j"), F.lit(False).alias("row"), "node", "component")
    cells = materialise(left.union(right), "cells")
    text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    text = materialise(text.join(cells.select("node").distinct(), "node", "left_semi"), "texts")

    def run(table: pa.Table) -> pa.Table:
        node, part, row = (table.column(c).to_numpy() for c in ("node", "component", "row"))
        sets = []
        for _, _, data, limits in blocks(table.column("text")):
            value, first = Words(data, limits, lower=True).shingles(k)
            sets += [np.unique(value[x:y]) for x, y in zip(first[:-1], first[1:])]
        x, y = np.flatnonzero(row), np.flatnonzero(~row)
        found = cell_links([sets[i] for i in x], [sets[j] for j in y], part[x][:, None] != part[y][None, :], percent)
        a, b = node[x[found[:, 0]]], node[y[found[:, 1]]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return cells.join(text, "node").groupBy("centre", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_shingles, component_id, kept``; ``component_id`` is the smallest id reachable."""
    sketch = materialise(sketches(docs, k, id_col, text_col, bins, rows), "sketches")
    nodes = materialise(
        sketch.where("bands is not null and id is not null").groupBy("set_key", "n_shingles")
        .agg(F.min("id").alias("node"), F.first("bands").alias("bands")), "nodes")  # equal sets have equal bands
    edges = materialise(star_edges(nodes), "star_edges")
    links = materialise(confirmed(edges, docs, k, percent, id_col, text_col), "links")
    parts = connected_components(links)
    more = materialise(rest_links(edges, parts, docs, k, percent, id_col, text_col), "links")
    if not more.isEmpty():
        parts = connected_components(links.union(more))
    named = nodes.join(parts, "node", "left").select("set_key", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = sketch.select("id", "n_shingles", "set_key").join(named, ["set_key", "n_shingles"], "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns."""
    found = materialise(near_duplicates(docs, k, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("gone")).distinct(), "gone")
    rows = docs.select(F.col(id_col).alias("id"), whole_row(docs).alias("row"))
    return rows.join(found, rows["id"] == found["gone"], "left_anti").select("row.*")
