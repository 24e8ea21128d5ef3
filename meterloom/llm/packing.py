"""Harmonic packing of token documents into sequences of a fixed capacity.

Capacity C is split into reciprocal classes: class k holds pieces of more than C/(k+1) and at most C/k tokens, and a
sequence of class k takes exactly k of them. Each task fills the classes with the documents it reads, on its own, and a
sequence is closed as soon as it has its fixed count. To leave no large gap, a document is cut: first into whole
sequences, then its rest up to :data:`CUTS` times to the largest class size ``C // k`` that fits, so that these pieces fill
their class exactly; what remains is a short piece of its own class. Pieces of classes that a task leaves unfinished (fewer
than k for each k) are joined and cut into full sequences, and the last one into sequences of powers of two, which need no
padding.

Memory of a task is one batch and less than one sequence for each class. A recomputed task reads the same rows and makes
the same sequences.

Defined results: null text counts as empty and holds the end id alone; rows that repeat an id are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.bpe import encoded
from meterloom.llm.tokens import default_tokenizer

CAPACITY = 2048
CUTS = 3
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pieces(length: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[int]:
    """The lengths a document is cut into, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    for _ in range(cuts):
        if not rest:
            break
        size = capacity // -(-capacity // rest)  # the largest capacity // k that is at most the rest
        out.append(size)
        rest -= size
    return out + [rest] * (rest > 0)


class Packer:
    """The classes of one task. ``take`` gives pieces of finished sequences, ``finish`` those of the rest."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}

    def _close(self, members: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, total, ids in members:
            yield doc, start, len(ids), total, self.sequence, offset, ids
            offset += len(ids)
        self.sequence += 1

    def take(self, doc: int | None, start: int, total: int, ids: np.ndarray) -> Iterator[tuple]:
        k = self.capacity // len(ids)
        members = self.open.setdefault(k, [])
        members.append((doc, start, total, ids if k == 1 else ids.copy()))
        if len(members) == k:
            yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        rest = [m for k in sorted(self.open) for m in self.open[k]]
        self.open = {}
        left = sum(len(m[3]) for m in rest)
        members, room = [], 0
        for doc, start, total, ids in rest:
            while len(ids):
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                    left -= room
                part, ids = ids[:room], ids[room:]
                members.append((doc, start, total, part))
                start, room = start + len(part), room - len(part)
                if not room:
                    yield from self._close(members)
                    members = []


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1, cuts: int = CUTS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian 32-bit)."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, held, size = Packer(capacity, TaskContext.get().partitionId() << 33), [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array([x.tobytes() for x in columns[6]], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        end = np.array([end_id], np.uint32)
        for batch in batches:
            for a, b, ids, first in encoded(tokenizer, batch.column(1)):
                for doc, x, y in zip(batch.column(0).slice(a, b - a).to_pylist(), first[:-1], first[1:]):
                    own, at = np.r_[ids[x:y], end], 0
                    for n in pieces(len(own), capacity, cuts):
                        for row in packer.take(doc, at, len(own), own[at : at + n]):
                            held.append(row)
                            size += row[2]
                        at += n
                    if size > 1 << 20:
                        yield batch_of(held)
                        held, size = [], 0
        held.extend(packer.finish())
        if held:
            yield batch_of(held)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
