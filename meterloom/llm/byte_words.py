"""Words of many texts at once, as NumPy arrays over one byte buffer.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text; no multi-byte character contains such a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.RandomState(20240611)
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUE = _RNG.randint(1, 2**62, 256, dtype=np.int64).astype(U64) * U64(4) + U64(3)
BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        fill = lambda b: np.multiply.accumulate(np.r_[U64(1), np.full(size - 1, b, U64)])
        _POWERS[size] = fill(U64(BASE)), fill(U64(pow(BASE, -1, 2**64)))
    return _POWERS[size]


class Words:
    """Buffer, document limits and words of a block of texts.

    ``start, end`` are byte positions of all words, ``doc`` their document's number in the block and ``first`` the
    number of the first word of each document (one entry more than documents).
    """

    def __init__(self, buffer: np.ndarray, limits: np.ndarray, lower: bool = False):
        self.limits = limits
        self.bytes = LOWER[buffer] if lower else buffer
        n = len(buffer)
        solid = ~IS_SPACE[buffer]
        cut = np.zeros(n + 1, bool)
        cut[limits] = True
        begins = solid & cut[:n]
        begins[1:] |= solid[1:] & ~solid[:-1]
        ends = solid & cut[1:]
        ends[:-1] |= solid[:-1] & ~solid[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, limits)
        self.doc = np.repeat(np.arange(len(limits) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        power, inverse = _powers(len(self.bytes))
        total = np.zeros(len(self.bytes) + 1, U64)
        np.cumsum(BYTE_VALUE[self.bytes] * power[: len(self.bytes)], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(hash, first)`` of all runs of ``k`` words; a document with fewer words has its whole sequence as one."""
        w, count = self.hashes(), np.diff(self.first)
        h = w.copy() if len(w) else w
        n = max(0, len(w) - k + 1)
        run = h[:n]
        for j in range(1, k):
            run = mix64(run * U64(0x9FB21C651E98DF25) + w[j : j + n])
        inside = self.doc[:n] == self.doc[k - 1 : k - 1 + n]
        value, doc = run[inside], self.doc[:n][inside]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            own = []
            for d in short:
                x = w[self.first[d] : self.first[d] + 1] * U64(3) + U64(int(count[d]))
                for j in range(1, count[d]):
                    x = mix64(x * U64(0x9FB21C651E98DF25) + w[self.first[d] + j])
                own.append(mix64(x)[0])
            value, doc = np.r_[value, np.array(own, U64)], np.r_[doc, short]
            order = np.argsort(doc, kind="stable")
            value, doc = value[order], doc[order]
        return value, np.searchsorted(doc, np.arange(len(count) + 1))


def blocks(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, limits)`` for runs of rows of about ``limit`` bytes; null counts as empty.

    A row is never cut, so a block is larger only where one text is.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8) if len(data) and data.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(data):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
