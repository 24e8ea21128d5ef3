"""Ranked lexical search with hashed max-sketches.

1. **Index**, one pass over the texts: a row per document with its number of terms, its distinct term hashes with their counts, and a
   *sketch* of ``width`` bytes. A term falls into the coordinate that its hash names, and each coordinate keeps the
   largest count of its terms. As the impact of a term rises with its count, the impact of a coordinate's count is the maximum of the
   impacts folded into it. A byte of 255 stands for "255 or more" and counts as the impact no count reaches.
2. **Bounds**: for a block of items, all look-ups are one matrix product: impacts of the coordinates times the weights of the items'
   terms there. No term of a document scores above its coordinate, so the product is an upper bound of every score.
3. **Rescoring**: each task goes through a batch of documents by descending bound and scores them exactly from their term
   counts, until the next bound lies below the item's threshold: the score of the last place of the best ``k`` so far. The
   first thresholds come from a search of a hashed part of the documents; they are lower bounds of the final ones, so they
   save work and change no result.

A task returns at most ``k`` documents per item that reach the first threshold; a window over those gives the ranks. Only
counters, the numbers of documents for the terms of one block of items and its first thresholds reach the driver: blocks
are bounded by :data:`BLOCK_ITEMS` and :data:`BLOCK_TERMS`. Nothing is shuffled but results.

A term is a 64-bit hash of its bytes: two of ten million terms meet with a chance of 3e-6.

Defined results: a null text has no terms; a document or item without terms takes no part; rows of documents that repeat an id are ranked
each; a null document id stands last among equal scores; rows that repeat an item's id form one item with the terms of
all; a null item id is an item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.byte_words import LOWER, U64, Words, blocks
from meterloom.session import materialise

WIDTH_BITS = 11
#: Documents whose bounds are computed together.
STRIP = 512
#: Documents that are scored before the threshold is looked at again.
STEP = 64
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 17
#: Documents searched for the first thresholds: this many, or this part of all if that is more.
SEED_ROWS, SEED_SHARE = 20_000, 0.001
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


class Terms(Words):
    """Runs of ASCII letters, digits and everything beyond ASCII, with A-Z lower-cased."""

    def __init__(self, buffer: np.ndarray, limits: np.ndarray):
        self.limits, self.bytes = limits, LOWER[buffer]
        n = len(buffer)
        solid = np.r_[False, _TERM[buffer], False]
        cut = np.zeros(n + 1, bool)
        cut[limits] = True
        inside = solid[1:-1]
        self.start = np.flatnonzero(inside & (cut[:n] | ~solid[:n]))
        self.end = np.flatnonzero(inside & (cut[1:] | ~solid[2:])) + 1
        self.first = np.searchsorted(self.start, limits)
        self.doc = np.repeat(np.arange(len(limits) - 1), np.diff(self.first))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, hash, count)`` of the distinct terms of each document, by document and hash."""
        h = self.hashes()
        order = np.lexsort((h, self.doc))
        h, doc = h[order], self.doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], h[at], np.diff(np.r_[at, len(h)])


def sketches(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n_docs: int, bits: int) -> np.ndarray:
    """One row of ``2**bits`` bytes per document: the largest count of the terms in each coordinate."""
    out = np.zeros((n_docs, 1 << bits), np.uint8)
    if len(h):
        coordinate = (h >> U64(64 - bits)).astype(np.int64)
        new = np.ones(len(h), bool)  # terms stand by document and hash, so those of a coordinate stand together
        new[1:] = (coordinate[1:] != coordinate[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        out[doc[at], coordinate[at]] = np.minimum(np.maximum.reduceat(count, at), 255)
    return out


def _cut(values: np.ndarray, first: np.ndarray) -> pa.Array:
    raw, byte = values.tobytes(), (first * values.itemsize).tolist()
    return pa.array([raw[a:b] for a, b in zip(byte, byte[1:])], pa.binary())


def index(docs: DataFrame, bits: int = WIDTH_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, terms, counts, sketch``: one row per document, in the partitions of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, limits in blocks(batch.column(1)):
                words = Terms(data, limits)
                doc, h, count = words.counts()
                first = np.searchsorted(doc, np.arange(b - a + 1))
                sketch = sketches(doc, h, count, b - a, bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(words.first).astype(np.int64)), _cut(h, first), _cut(count.astype("<u4"), first),
                     _cut(sketch.ravel(), np.arange(b - a + 1) << bits)], ["id", "n", "terms", "counts", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, terms binary, counts binary, sketch binary")


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items with their term hashes, in blocks of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, limits in blocks(batch.column(1)):
                doc, h, _ = Terms(data, limits).counts()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _cut(h, np.searchsorted(doc, np.arange(b - a + 1)))], ["item", "terms"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    parsed = rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, terms binary")
    stored = materialise(parsed.groupBy("item").agg(F.collect_list("terms").alias("terms")), "items")
    held, size = [], 0
    for row in stored.toLocalIterator():
        terms = np.unique(np.frombuffer(b"".join(row["terms"]), U64))
        if len(terms):
            if held and (len(held) == BLOCK_ITEMS or size + len(terms) > BLOCK_TERMS):
                yield held
                held, size = [], 0
            held.append((row["item"], terms))
            size += len(terms)
    if held:
        yield held


def _document_frequencies(indexed: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """The number of documents with each term of a sorted vocabulary."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), U64)
            at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            total += np.bincount(at[vocabulary[at] == terms], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "df"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in indexed.select("terms").mapInArrow(tally, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one row per term of the block
        out[row["term"]] = row["df"]
    return out


def impact(count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``count`` occurrences add per weight in a document of relative length ``length``."""
    return (1_000_000_000 * count) // (1000 * count + 20 * length)


class Searcher:
    """The items of one block with their weights, and the first thresholds."""

    def __init__(self, items: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, k: int, bits: int, seeds: np.ndarray):
        self.vocabulary, self.n_docs, self.n_terms, self.k, self.seeds = vocabulary, n_docs, n_terms, k, seeds
        self.strip = max(16, min(STRIP, (1 << 24) // max(1, len(vocabulary))))  # a table of counts has documents x vocabulary cells
        self.places = [np.searchsorted(vocabulary, terms) for terms in items]
        self.weights = [weights[p] for p in self.places]
        coordinate = (vocabulary >> U64(64 - bits)).astype(np.int64)
        self.coordinates, column = np.unique(coordinate, return_inverse=True)
        self.lookup = np.zeros((len(self.coordinates), len(items)))
        for i, (p, w) in enumerate(zip(self.places, self.weights)):
            np.add.at(self.lookup[:, i], column[p], w)

    def bounds(self, sketch: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, documents by items."""
        folded = sketch[:, self.coordinates].astype(np.int64)
        value = np.where(folded == 255, 1_000_000, impact(folded, length[:, None]))
        return (value.astype(np.float64) @ self.lookup) * (1 + 1e-12)  # above the rounding of sums beyond 2**53

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in self.places]
        floor = np.maximum(self.seeds, 1)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, self.strip):
                self._strip(batch.slice(at, self.strip), best, floor)
        if id_type is not None:
            rows = [(i, doc, -score) for i, found in enumerate(best) for score, _, doc in found]
            item, doc, score = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["place", "doc", "score"])

    def _strip(self, batch: pa.RecordBatch, best: list[list[tuple]], floor: np.ndarray) -> None:
        ids, n, terms, counts, sketch = batch.columns
        length = 50 + (50 * np.asarray(n) * self.n_docs) // self.n_terms
        bound = self.bounds(np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(len(ids), -1), length)
        hopeful = bound >= floor
        if not hopeful.any():
            return
        terms = terms.to_pylist()
        flat = np.frombuffer(b"".join(terms), U64)
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == flat
        owner = np.repeat(np.arange(len(ids)), [len(t) // 8 for t in terms])
        held = np.zeros((len(ids), len(self.vocabulary)), np.int32)
        held[owner[hit], at[hit]] = np.frombuffer(b"".join(counts.to_pylist()), "<u4")[hit]
        for i in np.flatnonzero(hopeful.any(0)).tolist():
            rows = np.flatnonzero(hopeful[:, i])
            rows = rows[np.argsort(-bound[rows, i], kind="stable")]
            for j in range(0, len(rows), STEP):
                some = rows[j : j + STEP]
                some = some[bound[some, i] >= floor[i]]
                if not len(some):
                    break  # every later bound is lower still
                score = impact(held[some[:, None], self.places[i]].astype(np.int64), length[some, None]) @ self.weights[i]
                good = np.flatnonzero(score >= floor[i])
                if len(good):
                    new = [(-int(score[g]), d is None, d) for g in good.tolist() for d in (ids[int(some[g])].as_py(),)]
                    best[i] = sorted(best[i] + new, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.k]
                    if len(best[i]) == self.k:
                        floor[i] = max(floor[i], -best[i][-1][0])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item; Spark cuts each task's rows to ``k`` per item before it shuffles them."""
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, bits: int = WIDTH_BITS, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` best documents of each item with a score above 0."""
    item_type = items.schema[item_col].dataType.simpleString()
    id_type = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    schema = f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long"
    indexed = materialise(index(docs, bits, id_col, text_col), "lexical_index", compression="zstd")
    n_docs, n_terms = indexed.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = None
    for block in _item_blocks(items, item_col, item_text_col) if n_terms else ():
        vocabulary = np.unique(np.concatenate([t for _, t in block]))
        df = _document_frequencies(indexed, vocabulary)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        own = (([t for _, t in block]), vocabulary, weights, n_docs, n_terms, k, bits)
        found_schema = f"place int, doc {id_type}, score long"
        share = max(SEED_ROWS / n_docs, SEED_SHARE)
        seeds = np.zeros(len(block), np.int64)
        if share < 0.5:
            # Rows of a document hash alike, so a repeated document stays whole; any subset gives valid thresholds.
            some = indexed.where(F.pmod(F.xxhash64("terms"), F.lit(1 << 20)) < int(share * (1 << 20)))
            early = some.mapInArrow(Searcher(*own, seeds), found_schema)
            for row in _ranked(early, k).where(F.col("rank") == k).collect():  # at most one row per item of the block
                seeds[row["place"]] = row["score"]
        ranked = materialise(_ranked(indexed.mapInArrow(Searcher(*own, seeds), found_schema), k), "ranked")
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"place int, item {item_type}")
        part = ranked.join(names, "place").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
