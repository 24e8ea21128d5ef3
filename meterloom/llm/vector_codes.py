"""Vector code compression: product quantisation over per-dimension value dictionaries.

A component x becomes the integer floor(4096 * x), a vector ``parts`` equal parts, and a part the number of the nearest entry
of its position's codebook. Vectors are stored once as blocks: for each dimension the sorted distinct integers of the block
and, for each vector, the place of its value in that dictionary (16 bits; a block has at most 65,536 rows). A round
tabulates, per dimension, the squared differences of every distinct integer to every entry; the distance of a part is then
gathered from those tables by code and added up, so an integer that many vectors share is subtracted and squared once.

Rounds are exact integer arithmetic. Each task adds up the integers and counts of the parts it gave to each entry and returns
``parts * entries`` rows; Spark adds those up and only the new codebooks (``entries`` vectors) reach the driver. Nothing
else is shuffled in a round, and a value, label or vector that a third of the rows share costs no more than others.

Defined results: vectors that are null, empty or hold null or non-finite components are dropped, and so are those whose length is
not that of the smallest kept id, or whose integers reach :func:`limit` (beyond it a sum of squares could pass 64 bits: more than
32,767 per component at 64 dimensions). The smallest ids are taken by (id, vector), so rows that repeat an id are separate
vectors; a null id stands last. Fewer vectors than entries give smaller codebooks. An empty table gives an empty result
and empty codebooks. A null label is a label; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.session import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a stored block.
BLOCK = 8192


def limit(dims: int) -> int:
    """Integers below this in size keep the error of a vector of ``dims`` components within 64 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


@dataclass
class Codebooks:
    """The entries as ``entries x dims`` integers; part p holds columns ``p * width`` to ``(p + 1) * width``."""

    entries: np.ndarray
    parts: int

    @property
    def width(self) -> int:
        return self.entries.shape[1] // self.parts

    def sha256(self) -> str:
        """Of all integers by part, entry and position, joined by commas."""
        if not self.entries.size:
            return hashlib.sha256(b"").hexdigest()
        ordered = self.entries.reshape(len(self.entries), self.parts, self.width).transpose(1, 0, 2).ravel()
        return hashlib.sha256(",".join(map(str, ordered.tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """``id, label, v``: kept vectors as arrays of integers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0)).where(F.coalesce(finite, F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))
    small = F.forall(x, lambda c: F.abs(c.cast("double")) * F.lit(float(SCALE)) < F.lit(float(limit(1))))
    return kept.where(small).select(F.col(id_col).alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), scaled.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def coded_blocks(rows: DataFrame, dims: int) -> DataFrame:
    """``ids, labels, sizes, values, codes``: blocks of vectors with a dictionary per dimension."""
    types = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                matrix = _matrix(some.column(2), dims)
                values, codes = zip(*(np.unique(matrix[:, j], return_inverse=True) for j in range(dims)))
                offsets = pa.array([0, len(some)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(offsets, some.column(0)), pa.ListArray.from_arrays(offsets, some.column(1)),
                     pa.array([[len(v) for v in values]], pa.list_(pa.int32())), pa.array([np.concatenate(values).astype("<i8").tobytes()], pa.binary()),
                     pa.array([np.stack(codes).astype("<u2").tobytes()], pa.binary())], ["ids", "labels", "sizes", "values", "codes"])

    return rows.mapInArrow(run, f"ids array<{types['id'].dataType.simpleString()}>, labels array<{types['label'].dataType.simpleString()}>, sizes array<int>, values binary, codes binary")


def _read(sizes, values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    flat = np.frombuffer(values, "<i8")
    return np.split(flat, np.cumsum(sizes)[:-1]), np.frombuffer(codes, "<u2").reshape(len(sizes), -1)


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of every part, parts by vectors; ties go to the lower entry."""
    chosen, least = [], []
    for p in range(books.parts):
        total = np.zeros((len(books.entries), codes.shape[1]), np.int64)
        for j in range(p * books.width, (p + 1) * books.width):
            table = (dictionaries[j][None, :] - books.entries[:, j : j + 1]) ** 2
            total += table[:, codes[j]]
        best = total.argmin(0)
        chosen.append(best)
        least.append(total[best, np.arange(codes.shape[1])])
    return np.stack(chosen), np.stack(least)


def _round(stored: DataFrame, books: Codebooks) -> Codebooks:
    """Codebooks of the parts' floored means; entries that no part chose stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books.entries), np.zeros((len(books.entries), books.parts), np.int64)
        for batch in batches:
            for sizes, values, raw in zip(*(c.to_pylist() for c in batch.columns)):
                dictionaries, codes = _read(sizes, values, raw)
                chosen, _ = nearest(dictionaries, codes, books)
                for p in range(books.parts):
                    counts[:, p] += np.bincount(chosen[p], minlength=len(counts))
                    for j in range(p * books.width, (p + 1) * books.width):
                        # How often each entry took each distinct integer, so that sums are products of counts and integers.
                        n = len(dictionaries[j])
                        taken = np.bincount(chosen[p] * n + codes[j], minlength=len(counts) * n).reshape(-1, n)
                        sums[:, j] += taken @ dictionaries[j]
        rows = [(p, e, int(counts[e, p]), sums[e, p * books.width : (p + 1) * books.width].tolist()) for e, p in np.argwhere(counts)]
        part, entry, count, total = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.int64()))],
                                         ["part", "entry", "n", "total"])

    partial = stored.select("sizes", "values", "codes").mapInArrow(run, "part int, entry int, n long, total array<long>")
    # Sums of 64-bit integers could pass 64 bits over very many rows: decimals cannot.
    added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.width)])
    entries = books.entries.copy()
    for row in added.collect():  # parts x entries rows
        for i in range(books.width):
            entries[row["entry"], row["part"] * books.width + i] = int(row[f"s{i}"]) // row["n"]
    return Codebooks(entries, books.parts)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str | None = "label") -> tuple[DataFrame, Codebooks]:
    """``(codes, codebooks)``: per kept vector ``id, label, code`` (an entry number per part) and ``error``, stored."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    rows = materialise(integers(vectors, id_col, vector_col, label_col), "integer_vectors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    dims = len(first[0]["v"]) if first else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    top = limit(dims)
    rows = rows.where((F.size("v") == dims) & F.forall("v", lambda c: F.abs(c) < top))
    smallest = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # as many rows as entries
    books = Codebooks(np.array([r["v"] for r in smallest], np.int64).reshape(len(smallest), dims), parts)
    schema = rows.schema
    out_schema = f"id {schema['id'].dataType.simpleString()}, label {schema['label'].dataType.simpleString()}, code binary, error long"
    if not smallest:
        return vectors.sparkSession.createDataFrame([], out_schema), books
    stored = materialise(coded_blocks(rows, dims), "coded_vectors", compression="zstd")
    for _ in range(rounds):
        books = _round(stored, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (sizes, values, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                chosen, least = nearest(*_read(sizes, values, raw), books)
                code = np.ascontiguousarray(chosen.T.astype(np.uint8)).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array([code[k : k + parts] for k in range(0, len(code), parts)], pa.binary()),
                     pa.array(least.sum(0))], ["id", "label", "code", "error"])

    return materialise(stored.mapInArrow(run, out_schema), "vector_codes"), books


def restore(code: bytes, books: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    return [int(books.entries[e, p * books.width + i]) / SCALE for p, e in enumerate(code) for i in range(books.width)]


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all vectors of the label, null labels together."""
    # Stored, so its size is known: the planner broadcasts it below its own threshold and splits hot labels beyond it.
    sums = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors").withColumnRenamed("label", "of")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")
