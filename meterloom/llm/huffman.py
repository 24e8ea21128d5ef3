"""Token ids in files of canonical, length-limited Huffman codes, decoded by table in independent blocks.

Code lengths come from the counts of every id of the whole corpus (package-merge, at most :data:`MAX_BITS` bits) and are
all that is stored of the code: canonical codes follow from them. A **frame** is one binary value of a Parquet row:

    "MLHF", format 1 (u16), code limit (u16), documents (u32), blocks (u32)
    ids (i64 each), null marks (u8 each), token counts (u32 each), bits of each block (u16), code bits

Documents stand in ascending id order; each starts at a byte, and has blocks of :data:`BLOCK` tokens. The bit counts of
the blocks are the checkpoints: all blocks of a frame are decoded in step, one table look-up for one token of every block.
``frames`` rows hold ``shard, frame, start`` (tokens of the shard before the frame), ``n_docs, n_tokens, payload``;
``codebook`` holds ``id, bits``. Shards are ranges of document ids, so their order is the order of ids.

Steps: token ids are written once; counts (one row per id of the vocabulary) and shard limits (one row per shard) go to the
driver; documents are encoded where they lie and only code bits are shuffled.

Defined results: null text counts as empty and holds the end id alone; null ids stand first; rows that repeat an id follow
each other by text order of their codes; an empty table writes no frame and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.bpe import encoded
from meterloom.llm.tokens import as_bytes, default_tokenizer
from meterloom.session import materialise

MAX_BITS = 16
BLOCK = 128
FRAME_TOKENS = 1 << 20
HEAD = "<4sHHII"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits for each id by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, flags = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both, leaf = np.r_[leaves, pairs], np.r_[np.ones(len(leaves), bool), np.zeros(len(pairs), bool)]
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        flags.append(leaf[rank])
    need, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(flags):
        own = int(leaf[:need].sum())
        lengths[:own] += 1
        need = 2 * (need - own)
    out[order] = lengths
    return out


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """The code of each id: ids ordered by (bits, id) get consecutive values."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    codes, code, last = np.zeros(len(bits), np.uint32), 0, 0
    width = bits[order]
    for n in np.unique(width):
        code <<= int(n) - last
        own = order[width == n]
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), int(n)
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(id, bits)`` for every value of the next ``limit`` bits."""
    limit = max(int(bits.max(initial=1)), 1)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    span = np.int64(1) << (limit - bits[order])
    ids, width = np.repeat(order, span), np.repeat(bits[order], span)
    rest = (1 << limit) - len(ids)  # codes that nothing uses
    return np.r_[ids, np.zeros(rest, np.int64)].astype(np.uint32), np.r_[width, np.ones(rest, np.int64)].astype(np.int64), limit


def encode_bits(ids: np.ndarray, first: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Code bits and block bit counts of each document.

    Codes are put into 64-bit words at their bit positions, documents beginning at whole bytes. Bits of different codes
    never meet, so a word is the bitwise sum of the codes that begin in it and of the rest of the one before.
    """
    width = bits[ids]
    ends = np.r_[0, np.cumsum(width)]
    n_bytes = -(-(ends[first[1:]] - ends[first[:-1]]) // 8)
    byte = np.r_[0, np.cumsum(n_bytes)]
    place = ends[:-1] + np.repeat(byte[:-1] * 8 - ends[first[:-1]], np.diff(first))
    word, left = place >> 6, 64 - (place & 63) - width
    code, over = codes[ids].astype(np.uint64), left < 0
    shifted = np.where(over, code >> np.where(over, -left, 0).astype(np.uint64), code << np.where(over, 0, left).astype(np.uint64))
    words = np.zeros((int(byte[-1]) >> 3) + 2, np.uint64)
    if len(ids):
        at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[at]] = np.bitwise_or.reduceat(shifted, at)
        words[word[over] + 1] |= code[over] << (64 + left[over]).astype(np.uint64)  # one code at most crosses into a word
    raw, cuts = words.astype(">u8").tobytes(), byte.tolist()
    marks = [np.diff(ends[np.r_[np.arange(a, b, BLOCK), b]]).astype(np.uint16).tobytes() for a, b in zip(first[:-1], first[1:])]
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])], marks


def decode_frame(payload: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc ids, null marks, first token of each document and the end, token ids)``."""
    magic, version, _, n_docs, n_blocks = struct.unpack_from(HEAD, payload)
    if magic != b"MLHF" or version != 1:
        raise ValueError("not a frame of this format")
    at = struct.calcsize(HEAD)
    parts = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u2", n_blocks)):
        parts.append(np.frombuffer(payload, kind, n, at))
        at += parts[-1].nbytes
    doc, null, count, block_bits = parts
    raw = np.r_[np.frombuffer(payload, np.uint8, offset=at), np.zeros(4, np.uint8)].astype(np.uint64)
    window = (raw[:-4] << np.uint64(32)) | (raw[1:-3] << np.uint64(24)) | (raw[2:-2] << np.uint64(16)) | (raw[3:-1] << np.uint64(8)) | raw[4:]
    count = count.astype(np.int64)
    blocks = -(-count // BLOCK)
    first_block, first = np.r_[0, np.cumsum(blocks)], np.r_[0, np.cumsum(count)]
    size = block_bits.astype(np.int64)
    ends = np.r_[0, np.cumsum(size)]
    doc_bits = ends[first_block[1:]] - ends[first_block[:-1]]
    doc_byte = np.r_[0, np.cumsum(-(-doc_bits // 8))][:-1]
    owner = np.repeat(np.arange(n_docs), blocks)
    nth = np.arange(n_blocks) - first_block[owner]
    offset = doc_byte[owner] * 8 + ends[:-1] - ends[first_block[owner]]
    place, left = first[owner] + nth * BLOCK, np.minimum(BLOCK, count[owner] - nth * BLOCK)
    order = np.argsort(-left, kind="stable")  # blocks that end early stand last
    offset, place, left = offset[order], place[order], left[order]
    ids, (symbol, width, limit) = np.zeros(first[-1], np.uint32), table
    mask = np.uint64((1 << limit) - 1)
    for step in range(int(left.max(initial=0))):
        live = int(np.searchsorted(-left, -step, side="left"))
        o = offset[:live]
        peek = ((window[o >> 3] >> (40 - limit - (o & 7)).astype(np.uint64)) & mask).astype(np.int64)
        ids[place[:live] + step] = symbol[peek]
        offset[:live] = o + width[peek]
    return doc, null, first, ids


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, seen, counts``: a row per document with its ids (little-endian 32-bit, the end id last) and, from each task,
    one row with the distinct ids it has ``seen`` and how often; ``seen`` is null on the rows of documents."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, total = np.uint32(end_id).tobytes(), np.zeros(end_id + 1, np.int64)
        for batch in batches:
            for a, b, ids, first in encoded(tokenizer, batch.column(1)):
                own = np.bincount(ids, minlength=len(total))
                own[: len(total)] += total
                own[end_id] += b - a
                total = own
                raw, byte = ids.astype("<u4").tobytes(), (first * 4).tolist()
                none = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([raw[x:y] + tail for x, y in zip(byte, byte[1:])], pa.binary()), none, none],
                                                 ["id", "ids", "seen", "counts"])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<u4").tobytes()], pa.binary()),
                                          pa.array([total[seen].astype("<i8").tobytes()], pa.binary())], ["id", "ids", "seen", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tokenise, "id long, ids binary, seen binary, counts binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, from the side rows of :func:`token_table`; one row per vocabulary id reaches the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seen, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(seen, "<u4").astype(np.int64)), pa.array(np.frombuffer(counts, "<i8"))], ["id", "n"])

    counted = tokens.where("seen is not null").select("seen", "counts").mapInArrow(rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 max_bits: int = MAX_BITS, shards: int | None = None) -> None:
    """Encodes all texts and writes ``path/frames`` and ``path/codebook``."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    stored = materialise(token_table(docs, tokenizer, end_id, id_col, text_col), "token_ids", compression="zstd")
    counts = id_counts(stored)
    tokens = stored.where("seen is null").select("id", "ids")
    bits = code_lengths(counts, max_bits)
    codes = canonical_codes(bits)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // (64 * FRAME_TOKENS)))
    limits = tokens.select("id").where("id is not null").repartitionByRange(shards, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("top"))
    tops = np.array(sorted(r["top"] for r in limits.collect())[:-1], np.int64)  # one row per shard

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = as_bytes(batch.column(1))
            sizes = np.array([len(x) // 4 for x in values], np.int64)
            keys = batch.column(0)
            shard = np.searchsorted(tops, np.asarray(keys.fill_null(-(2**63))))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), FRAME_TOKENS, side="right")))
                raw = b"".join(values[at:to])
                data, marks = encode_bits(np.frombuffer(raw, np.uint32), np.r_[0, np.cumsum(sizes[at:to])], bits, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[at:to].astype(np.int32)), keys.slice(at, to - at), pa.array(sizes[at:to]), pa.array(marks, pa.binary()), pa.array(data, pa.binary())],
                    ["shard", "id", "n", "marks", "bits"])
                at = to

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, number, start, size = [], None, 0, 0, 0

        def flush():
            nonlocal held, number, start, size
            ids = np.array([0 if h[0] is None else h[0] for h in held], "<i8").tobytes()
            nulls = np.array([h[0] is None for h in held], "u1").tobytes()
            payload = b"".join([
                struct.pack(HEAD, b"MLHF", 1, max_bits, len(held), sum(len(h[2]) for h in held) // 2), ids, nulls,
                np.array([h[1] for h in held], "<u4").tobytes(), *(h[2] for h in held), *(h[3] for h in held)])
            out = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
                (shard, pa.int32()), (number, pa.int64()), (start, pa.int64()), (len(held), pa.int64()), (size, pa.int64()), (payload, pa.binary()))],
                ["shard", "frame", "start", "n_docs", "n_tokens", "payload"])
            held, number, start, size = [], number + 1, start + size, 0
            return out

        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (s != shard or size >= FRAME_TOKENS):
                    yield flush()
                if s != shard:
                    shard, number, start = s, 0, 0
                held.append(row)
                size += row[1]
        if held:
            yield flush()

    packed = tokens.mapInArrow(compress, "shard int, id long, n long, marks binary, bits binary")
    # A partition per shard: none is dealt two shards, and files stand in the order of ids.
    dealt = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "bits")
    dealt.mapInArrow(frame, "shard int, frame long, start long, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/frames")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the files in ``path``; ``start`` counts the tokens of all documents before."""
    frames = spark.read.schema("shard int, frame long, start long, n_docs long, n_tokens long, payload binary").parquet(f"{path}/frames")
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per vocabulary id
    bits = np.zeros(max((r["id"] for r in book), default=0) + 1, np.int64)
    for r in book:
        bits[r["id"]] = r["bits"]
    totals = {r["shard"]: r["n"] for r in frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per shard
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(bits)
        for batch in batches:
            for shard, start, payload in zip(*(c.to_pylist() for c in batch.columns)):
                doc, null, first, ids = decode_frame(payload, table)
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc, mask=null.astype(bool)), pa.array(before[shard] + start + first[:-1]), pa.array(np.diff(first)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return frames.select("shard", "start", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")
