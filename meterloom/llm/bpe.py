"""Byte-level BPE encoding and decoding with forced boundaries.

A merge only ever builds tokens of the vocabulary. Two neighbouring bytes that stand next to each other inside no token
are therefore never merged, and the boundary between them is certain whatever surrounds it. :class:`ForcedCuts` looks every
pair of neighbouring bytes up in a table of 256 x 256 marks, cuts there, has each distinct fragment encoded on its own by
the tokenizer and joins the ids.

The tokenizer also splits a text by a pattern before it merges. A cut is only taken where that pattern, applied to the
fragments, gives the pieces it gives on the whole text (white space, ``'`` and the text of added tokens look at their
neighbours):

- before and after white space, but not inside a run of it, nor behind a run of two or more;
- not behind ``'`` or the character after it, and before ``'`` only behind an ASCII letter or digit;
- not inside a character, and around an added token (such as ``<|endoftext|>``) exactly at its ends: the tokenizer takes
  those out of the text first.

A tokenizer of another kind (:func:`cuts_hold`) gets its texts whole, so results are the library's in every case.

Memory of a task is a block of about 2 MB of text (or one longer text) and a bounded table of known fragments. Nothing is
shuffled; a recomputed task gives the same rows.

Defined results: null text counts as empty and has no ids; ids of rows pass through with their own type, null or repeated;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.byte_words import blocks
from meterloom.llm.tokens import as_bytes, default_tokenizer, grown

#: Fragments, and bytes of fragments, that a worker remembers; beyond either it starts anew.
FRAGMENTS, FRAGMENT_BYTES = 300_000, 16 << 20
BLOCK_BYTES = 1 << 21
#: Fragments that are encoded in one call.
RUN = 1000
QUOTE = 39
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Characters beyond ASCII that are white space, as UTF-8.
_WIDE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file; a token with a foreign symbol stands for its own text."""
    symbols = byte_of_symbol()
    tokens = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(tokens.values(), default=-1) + 1)
    for token, i in tokens.items():
        out[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
    return out


def cuts_hold(spec: dict) -> bool:
    """Whether a tokenizer file describes a byte-level BPE with the usual pattern and nothing around it."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec.get("post_processor") is None and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
            and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")))


def apart(spec: dict) -> np.ndarray:
    """For each pair of bytes (first * 256 + second) whether it stands inside no token of the vocabulary."""
    inside = np.zeros((256, 256), bool)
    symbols = byte_of_symbol()
    for token in spec["model"]["vocab"]:
        own = [symbols[c] for c in token if c in symbols]
        inside[own[:-1], own[1:]] = True
    return ~inside.ravel()


class ForcedCuts:
    """One tokenizer, its table of byte pairs and the fragments seen so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.exact = cuts_hold(spec)
        if self.exact:
            self.apart = apart(spec)
            self.width = np.array([len(t) for t in token_bytes(spec)], np.int64)
            self.added = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
            self.any_added = re.compile(b"|".join(map(re.escape, self.added))) if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = self.held = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fragments: list[bytes]) -> None:
        """Encodes new fragments. Neighbours whose joint is a forced boundary go to the library as one text, whose ids are
        dealt out again by the bytes they stand for: one call for thousands of fragments."""
        lengths = np.fromiter(map(len, fragments), np.int64, len(fragments))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = b"".join(fragments)
        marks = self.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[starts]
        marks[::RUN] = False
        heads = np.flatnonzero(~marks)
        runs = [raw[a:b].decode("utf-8") for a, b in zip(starts[heads].tolist(), np.r_[starts[heads[1:]], len(raw)].tolist())]
        ids = np.array([i for x in self._library(runs) for i in x], np.uint32)
        reach = np.cumsum(self.width[ids])
        cut = np.searchsorted(reach, ends, side="left") + 1
        sizes = np.diff(np.r_[0, cut])
        n, m = len(self.index), len(fragments)
        self.ids = grown(self.ids, self.used + len(ids))
        self.start, self.size = grown(self.start, n + m), grown(self.size, n + m)
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + cut - sizes
        self.size[n : n + m] = sizes
        self.used += len(ids)
        self.held += len(raw)
        self.index.update(zip(fragments, range(n, n + m)))

    def cuts(self, data: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Marks for each byte position of a buffer and its end: whether a fragment begins there."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            left, right = data[:-1], data[1:]
            blank, quote = _BLANK[data], data == QUOTE
            wide = np.zeros(n, bool)
            raw = data.tobytes()
            if data.max() > 0xC1:
                for m in _WIDE.finditer(raw):
                    wide[m.start() : m.end()] = True
                blank |= wide
            first = np.zeros(n + 1, bool)
            first[limits] = True
            second = blank[:-1] & ~first[1:-1]  # a blank at p - 2 of the same document, for position p
            ok = self.apart[left.astype(np.uint16) * np.uint16(256) + right]
            ok &= (right & 0xC0) != 0x80
            ok &= ~(blank[:-1] & blank[1:]) & ~wide[:-1] & ~quote[:-1] & (~quote[1:] | _ALNUM[left])
            ok[1:] &= ~(blank[1:-1] & second[:-1]) & ~quote[:-2]
            cut[1:n] = ok
            if self.any_added is not None and any(a in raw for a in self.added):
                for a, b in zip(limits[:-1].tolist(), limits[1:].tolist()):
                    for m in self.any_added.finditer(raw, a, b):
                        cut[m.start() : m.end()] = False
                        cut[[m.start(), m.end()]] = True
        cut[limits] = True
        cut[0] = True
        return cut

    def block(self, data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, first)``: the ids of all texts in a byte buffer, and the first of each text (one entry more than texts)."""
        if not self.exact:
            each = self._library([data[a:b].tobytes().decode("utf-8") for a, b in zip(limits[:-1], limits[1:])])
            ids = np.array([i for x in each for i in x], np.uint32)
            return ids, np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(limits), np.int64)
        at = np.flatnonzero(self.cuts(data, limits)).astype(np.int32)
        fragments = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
        coded = fragments.dictionary_encode()
        distinct = as_bytes(coded.dictionary)
        if len(self.index) + len(distinct) > FRAGMENTS or self.held > FRAGMENT_BYTES:
            self._forget()
        find = self.index.get
        if new := [f for f in distinct if find(f) is None]:
            self._learn(new)
        entry = np.fromiter(map(find, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        sizes = self.size[entry]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.start[entry] - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.r_[0, ends][np.searchsorted(at, limits)]


@functools.lru_cache(maxsize=2)
def forced_cuts(path: str) -> ForcedCuts:
    """The encoder of this worker process."""
    return ForcedCuts(path)


def encoded(path: str, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, ids, first id of each row and the end)`` for runs of rows."""
    cuts = forced_cuts(path)
    for a, b, data, limits in blocks(texts, BLOCK_BYTES):
        yield a, b, *cuts.block(data, limits)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> pa.Array:
    """The bytes of every id, of this worker process; the file's vocabulary bounds its size."""
    with open(path, encoding="utf-8") as f:
        return pa.array(token_bytes(json.load(f)), pa.large_binary())


def _schema(docs: DataFrame, id_col: str, more: str) -> str:
    return f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {more}"


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids`` with ids as little-endian 32-bit integers; special strings in a text are special tokens."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, first in encoded(path, batch.column(1)):
                raw, byte = ids.astype("<u4").tobytes(), (first * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array([raw[x:y] for x, y in zip(byte, byte[1:])], pa.binary())],
                    [id_col, "n_tokens", "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, _schema(docs, id_col, "n_tokens long, ids binary"))


def decode(coded: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids, decoded``: the text of each list of ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD, as ids need not end at characters; an id beyond the vocabulary has no text and null
    ids give an empty one.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for a, b, data, limits in blocks(batch.column(1), BLOCK_BYTES):
                ids = np.frombuffer(data.tobytes(), "<u4")
                text = words.take(pa.array(np.minimum(ids, len(words)), pa.int64(), mask=ids >= len(words)))
                at = np.frombuffer(text.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
                raw = text.buffers()[2].to_pybytes() if len(ids) and text.buffers()[2] is not None else b""
                byte = at[limits // 4].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array([raw[x:y].decode("utf-8", "replace") for x, y in zip(byte, byte[1:])], pa.string())], [id_col, ids_col, "decoded"])

    rows = coded.select(F.col(id_col), F.col(ids_col))
    return rows.mapInArrow(run, _schema(coded, id_col, f"`{ids_col}` binary, decoded string"))
