"""Quality rules, line first.

Every line with a word is tested by rules on its own: punctuation (shouting, symbol or exclamation noise), navigation (menu words or
separators) and boilerplate (notices that stand on many pages). Failed lines are
removed, and a document is rejected if less than :data:`KEEP_PERCENT` of its word characters is left. Before that, base counts
of the whole text reject very short and highly repetitive texts.

Defined results: null text counts as empty; an empty text has all counts 0 and is rejected as too short; each row is judged
alone, so repeated rows get equal results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.byte_words import IS_SPACE, U64, Words, blocks, mix64

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, KEEP_PERCENT = 10, 20, 5, 50
SYMBOLS = b"#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"
#: A line that matches one of these fails. Written so that RE2 and Python read them alike.
LINE_RULES = {
    "shouting": r"^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$",
    "symbols": r"[#*$%&|<>][^#*$%&|<>]{0,12}[#*$%&|<>][^#*$%&|<>]{0,12}[#*$%&|<>][^#*$%&|<>]{0,12}[#*$%&|<>]",
    "exclamation": r"[!?]{2}[^!?]{1,25}[!?]{2}[^!?]{1,25}[!?]{2}",
    "navigation": r"^[\x20\x09-\x0D]*([Hh]ome|[Mm]enu|[Ll]og ?in|[Ss]ign (up|in)|[Nn]ext|[Pp]revious|[Ss]kip to content|[Rr]ead more|[Ss]hare this|[Bb]ack to top)"
                  r"([\x20\x09-\x0D]*[|>/\-][^.]*)?[\x20\x09-\x0D]*$|[|][^|]*[|][\x20\x09-\x0D]*$",
    "boilerplate": r"([Aa]ll rights reserved|[Cc]ookie policy|uses cookies|[Pp]rivacy policy|[Tt]erms of (use|service)|[Ee]nable [Jj]ava[Ss]cript|[Ll]orem ipsum)",
}
_RULES = [regex.compile(r) for r in LINE_RULES.values()]


def repeated_words(w: Words) -> np.ndarray:
    """For each document the words that lie in a window of five words found twice or more in it."""
    h, docs = w.hashes(), len(w.limits) - 1
    n = max(0, len(h) - WINDOW + 1)
    run = mix64(w.doc[:n].astype(U64) + U64(1))
    for j in range(WINDOW):
        run = mix64(run * U64(0x9FB21C651E98DF25) + h[j : j + n])
    inside = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 : WINDOW - 1 + n])
    _, back, count = np.unique(run[inside], return_inverse=True, return_counts=True)
    start = inside[count[back] > 1]
    change = np.zeros(len(h) + 1, np.int64)
    change[start] += 1
    np.subtract.at(change, start + WINDOW, 1)
    return np.bincount(w.doc[np.cumsum(change[:-1]) > 0], minlength=docs)


def line_counts(text: str) -> tuple[int, int, int, list[int]]:
    """``(lines with a word, repeated lines, word characters left, numbers of failed lines)``."""
    seen, lines, repeated, left, failed = set(), 0, 0, 0, []
    for i, line in enumerate(text.split("\n")):
        raw = line.encode().translate(None, b" \t\n\v\f\r")
        if not raw:
            continue
        lines += 1
        repeated += line in seen
        seen.add(line)
        if any(r.search(line) for r in _RULES):
            failed.append(i)
        else:
            left += len(raw.decode())
    return lines, repeated, left, failed


def quality(docs: DataFrame, keep_percent: int = KEEP_PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, ``left_chars``
    (word characters after cleaning), ``failed_lines`` (numbers from 0) and ``clean_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_symbol = np.zeros(256, bool)
        is_symbol[list(SYMBOLS)] = True
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b, data, limits in blocks(texts):
                w = Words(data, limits)
                each = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][limits])  # noqa: E731, B023
                words, repeat = np.diff(w.first), repeated_words(w)
                chars = each(~IS_SPACE[data] & ((data & 0xC0) != 0x80))
                own = texts.slice(a, b - a).to_pylist()
                lines = [line_counts(t) for t in own]
                left = np.array([x[2] for x in lines], np.int64)
                bad = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
                clean = ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in set(f)) if f else t for t, (_, _, _, f) in zip(own, lines)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words), pa.array(chars), pa.array(each(is_symbol[data])), pa.array([x[1] for x in lines], pa.int64()),
                     pa.array(repeat), pa.array(bad), pa.array(~bad & (100 * left >= keep_percent * chars)), pa.array(left),
                     pa.array([x[3] for x in lines], pa.list_(pa.int32())), pa.array(clean, pa.string())],
                    ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars", "failed_lines", "clean_text"])

    schema = ("id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
              "left_chars long, failed_lines array<int>, clean_text string")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
