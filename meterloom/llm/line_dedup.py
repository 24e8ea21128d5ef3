"""Line deduplication across documents by pairwise alignment.

A document here is an id with a text; documents stand in the order of (id, hash of the text). Lines are compared without white space
around them, and lines without a word count nowhere.

1. **Candidates.** A *run* is the shortest sequence of neighbouring lines, from each line on, that has ``min_words`` words: one line
   where lines are long, several where they are short. Two documents with a common block of that size share a run. A *rare*
   run (at most ``rare`` holders) pairs each holder with every earlier one. A run of more holders pairs each
   holder with the first: n - 1 pairs instead of their square, and still every document with a common block gets a partner
   that holds its run. Nothing is capped.
2. **Alignment.** Each pair (later, earlier) is aligned by patience over *all* lines that the two share: those which each has once
   are the cards, the longest run of cards that rises in both is kept, and between two kept cards repeated lines are
   matched in order. Lines next to each other in both documents form a block.
3. **Deletion.** Blocks of at least ``min_words`` words are deleted from the later document. The earlier one is never changed by
   the pair, and the first holder of a run keeps it, so one copy of each passage stays.

Hot lines and hubs: holders of a run are counted before they are joined, only rare ones are ever gathered (at most ``rare``
of them), and the lines of a pair meet by (earlier document, line), so a document with thousands of partners is spread over
its lines. No document's text travels to its partners.

Defined results: null text counts as empty; a null id takes no part and keeps its text; rows that repeat id and text are one
document and lose the same lines; rows that repeat an id with other texts are documents of their own; an empty table gives an
empty result; further columns are passed through in ``row``. Ids keep their type.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meterloom.llm.byte_words import BYTE_VALUE, U64, Words, _powers, blocks, mix64
from meterloom.llm.tables import text_or_empty, whole_row
from meterloom.session import materialise

RARE = 4
MIN_WORDS = 8
#: A second value for each byte, so that a line has 128 bits.
_OTHER_VALUE = mix64(BYTE_VALUE) | U64(1)
_LINES = "lines array<struct<x:long,y:long,words:int,at:array<long>>>, runs array<struct<x:long,y:long>>"


def text_mark(text: Column) -> Column:
    """Tells texts of the same id apart."""
    return F.xxhash64(text)


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for each span, from running sums."""
    power, inverse = _powers(len(values) + 1)
    total = np.r_[U64(0), np.cumsum(values * power[: len(values)])]
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


class Lines:
    """The lines with a word of a block of texts: document, number in its text, words and a hash of 128 bits."""

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        words = Words(data, limits)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, words.start)
        new = np.ones(len(words.start), bool)
        new[1:] = (line[1:] != line[:-1]) | (words.doc[1:] != words.doc[:-1])
        at = np.flatnonzero(new)
        self.doc = words.doc[at]
        self.number = line[at] - np.searchsorted(breaks, limits[:-1])[self.doc]
        self.words = np.diff(np.r_[at, len(words.start)])
        self.first = np.searchsorted(self.doc, np.arange(len(limits)))
        start, end = words.start[at], words.end[np.r_[at[1:], len(words.start)] - 1] if len(at) else words.end
        self.x, self.y = (_spans(v[data], start, end) if len(at) else np.zeros(0, U64) for v in (BYTE_VALUE, _OTHER_VALUE))

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, x, y)`` of the shortest sequences of lines with ``min_words`` words, each once per document."""
        n = len(self.doc)
        ends = np.cumsum(self.words)
        stop = np.searchsorted(ends, ends - self.words + min_words, side="left") + 1
        whole = np.flatnonzero(stop <= self.first[self.doc + 1]) if n else np.zeros(0, np.int64)
        if not len(whole):
            return whole, np.zeros(0, U64), np.zeros(0, U64)
        x, y = (_spans(v, whole, stop[whole]) for v in (self.x, self.y))
        doc = self.doc[whole]
        order = np.lexsort((y, x, doc))
        doc, x, y = doc[order], x[order], y[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return doc[new], x[new], y[new]


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, lines, runs`` per document: its distinct lines with all their places, and its runs.

    A place is the number among the lines with a word (upper 32 bits) and the number in the text (lower 32 bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, limits in blocks(batch.column(2)):
                lines = Lines(data, limits)
                order = np.lexsort((np.arange(len(lines.doc)), lines.y, lines.x, lines.doc))
                doc, x, y = lines.doc[order], lines.x[order], lines.y[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                at = np.flatnonzero(new)
                place = ((np.arange(len(doc)) - lines.first[lines.doc]) << 32 | lines.number)[order]
                places = pa.ListArray.from_arrays(pa.array(np.r_[at, len(doc)].astype(np.int32)), pa.array(place))
                held = pa.StructArray.from_arrays([pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(lines.words[order][at].astype(np.int32)), places],
                                                  ["x", "y", "words", "at"])
                run_doc, run_x, run_y = lines.runs(min_words)
                found = pa.StructArray.from_arrays([pa.array(run_x.view(np.int64)), pa.array(run_y.view(np.int64))], ["x", "y"])
                each = np.arange(b - a + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[at], each).astype(np.int32)), held),
                     pa.ListArray.from_arrays(pa.array(np.searchsorted(run_doc, each).astype(np.int32)), found)], ["id", "mark", "lines", "runs"])

    text = text_or_empty(text_col)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_mark(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, {_LINES}")


def rising(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising run (patience sorting)."""
    tops, piles, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back[i] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(places: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The aligned places ``(later, earlier)``, in order.

    ``places`` holds, for each shared line, its sorted places in the later and in the earlier document. Cards are lines that
    each document has once.
    """
    cards = sorted((a[0], b[0]) for a, b in places if len(a) == len(b) == 1)
    kept = [cards[i] for i in rising([b for _, b in cards])]
    out, at, low = list(kept), 0, -1
    fences = [(-1, -1), *kept, (1 << 62, 1 << 62)]
    for place, line in sorted((x, n) for n, (a, b) in enumerate(places) if len(a) > 1 or len(b) > 1 for x in a):
        while place > fences[at + 1][0]:
            at += 1
            low = max(low, fences[at][1])
        theirs = places[line][1]
        i = bisect_right(theirs, low)
        if i < len(theirs) and theirs[i] < fences[at + 1][1]:
            low = theirs[i]
            out.append((place, low))
    return sorted(out)


def _blocks(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept_rows, lines = [], []
        for row, shared in enumerate(batch.column(2).to_pylist()):
            words = {place: s["words"] for s in shared for place in s["at"]}
            kept, out, i = patience([(s["at"], s["theirs"]) for s in shared]), [], 0
            while i < len(kept):
                j = i + 1
                while j < len(kept) and all(kept[j][k] >> 32 == (kept[j - 1][k] >> 32) + 1 for k in (0, 1)):
                    j += 1
                if sum(words[place] for place, _ in kept[i:j]) >= min_words:
                    out += [place & 0xFFFFFFFF for place, _ in kept[i:j]]
                i = j
            if out:
                kept_rows.append(row)
                lines.append(out)
        taken = batch.take(pa.array(kept_rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(lines, pa.list_(pa.int32()))], ["later", "earlier", "lines"])


def candidate_pairs(table: DataFrame, rare: int = RARE) -> DataFrame:
    """``later, earlier`` (structs of id and mark): documents that share a run."""
    holders = table.select(F.struct("id", "mark").alias("doc"), F.explode("runs").alias("run"))
    shared = holders.groupBy("run").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Merge joins at every size: the tables on the right grow with the corpus.
    found = materialise(holders.join(materialise(shared, "shared_runs").hint("merge"), "run").select("run", "doc", "first", "n"), "holders")
    hubs = found.where((F.col("n") > rare) & (F.col("doc") != F.col("first"))).select(F.col("doc").alias("later"), F.col("first").alias("earlier"))
    few = found.where(F.col("n") <= rare).groupBy("run").agg(F.array_sort(F.collect_set("doc")).alias("docs"))  # at most ``rare`` each
    each = few.select("docs", F.posexplode("docs").alias("i", "later")).select("later", F.explode(F.slice("docs", F.lit(1), F.col("i"))).alias("earlier"))
    return hubs.union(each).distinct()


def common_blocks(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``later, earlier, lines``: numbers of the lines of ``later`` in aligned blocks of the pair; documents are structs of id and mark."""
    table = materialise(line_table(docs, min_words, id_col, text_col), "lines", compression="zstd")
    pairs = materialise(candidate_pairs(table, rare), "pairs")
    own = table.dropDuplicates(["id", "mark"]).select(F.struct("id", "mark").alias("later"), "lines")
    wanted = pairs.join(own.hint("merge"), "later").select("later", "earlier", F.explode("lines").alias("line"))
    theirs = table.dropDuplicates(["id", "mark"]).select(F.struct("id", "mark").alias("earlier"), "lines").join(pairs.select("earlier").distinct().hint("merge"), "earlier", "left_semi")
    theirs = theirs.select("earlier", F.explode("lines").alias("their"))
    both = wanted.join(theirs.hint("merge"), (wanted["earlier"] == theirs["earlier"]) & (F.col("line.x") == F.col("their.x")) & (F.col("line.y") == F.col("their.y")))
    shared = both.groupBy("later", wanted["earlier"]).agg(F.collect_list(F.struct("line.words", F.col("line.at").alias("at"), F.col("their.at").alias("theirs"))).alias("shared"))
    doc = shared.schema["later"].dataType.simpleString()
    return shared.mapInArrow(lambda batches: _blocks(batches, min_words), f"later {doc}, earlier {doc}, lines array<int>")


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``id, clean_text``, ``removed`` (line numbers from 0) and ``partners`` (for each
    removed line the earliest document it was aligned with, ids once each)."""
    each = common_blocks(docs, min_words, rare, id_col, text_col).select("later", "earlier", F.explode("lines").alias("line"))
    gone = materialise(
        each.groupBy("later", "line").agg(F.min("earlier").alias("earlier")).groupBy("later").agg(
            F.array_sort(F.collect_list("line")).alias("removed"),
            F.array_sort(F.collect_set("earlier.id")).alias("partners")).select("later.id", "later.mark", "removed", "partners"), "removed_lines")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text_mark(text).alias("mark"), whole_row(docs).alias("row"))
    both = rows.join(gone.hint("merge"), ["id", "mark"], "left").select("row", "id", "removed", "partners")
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(0).field(place), []
            for i, removed in enumerate(batch.column(2).to_pylist()):
                plain = texts[i].as_py() or ""
                if removed:
                    numbers = set(removed)
                    plain = "\n".join(line for k, line in enumerate(plain.split("\n")) if k not in numbers)
                out.append(plain)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), batch.column(2), batch.column(3)],
                                             ["row", "id", "clean_text", "removed", "partners"])

    types = both.schema
    schema = StructType([types["row"], types["id"], StructField("clean_text", StringType()), types["removed"], types["partners"]])
    done = both.mapInArrow(clean, schema)
    return done.withColumns({c: F.coalesce(c, F.array().cast(types[c].dataType)) for c in ("removed", "partners")})
