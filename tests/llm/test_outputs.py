"""Chat formatting, token files and packing: exact round trips and invariants."""

import json
import zlib

import numpy as np
import pytest

from meterloom.llm import chat, huffman, packing
from meterloom.llm.tokens import default_tokenizer
from meterloom.session import scratch_path

SCHEMA = "doc_id long, text string, row string, ids string, start int, length int"
ODD = [(4, "héllo wörld, this is <|endoftext|> text.\n\n  x"), (1, None), (2, ""), (3, " "), (9, "word     日本語 " * 900), (7, "a,b.c\nd\r\n" * 50), (7, "a,b.c\nd\r\n" * 50)]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "x", 1, 2) for i, t in rows], SCHEMA)


def test_token_files_round_trip(spark, sf_documents, reference):
    for docs in (frame(spark, ODD), sf_documents):
        path = scratch_path(spark, "tokens")
        huffman.write_tokens(docs, path, end_id=2)
        got = sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in huffman.read_tokens(spark, path).collect())
        want, at = [], 0
        for i, t in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: x[0]):
            ids = np.array([*reference(t), 2], "<u4")
            want.append((i, at, len(ids), ids.tobytes()))
            at += len(ids)
        assert got == want


def test_token_files_of_no_rows_and_null_ids(spark):
    path = scratch_path(spark, "tokens")
    huffman.write_tokens(frame(spark, []), path)
    assert huffman.read_tokens(spark, path).count() == 0
    path = scratch_path(spark, "tokens")
    huffman.write_tokens(frame(spark, [(None, "x y"), (3, "z")]), path)
    assert sorted((str(r["doc_id"]), r["start"]) for r in huffman.read_tokens(spark, path).collect()) == [("3", 3), ("None", 0)]


def test_code_lengths_are_limited_and_complete():
    counts = np.array([int(1.6**i) + 1 for i in range(40)], np.int64)
    for limit in (6, 10, 15):
        bits = huffman.code_lengths(counts, limit)
        assert bits.max() <= limit and sum(2.0 ** -b for b in bits) <= 1.0
        assert np.all(np.diff(bits) <= 0)


def test_packing_holds_every_id_once(spark, sf_documents, reference):
    for docs in (frame(spark, ODD[:-1]), sf_documents):
        rows = packing.pack(docs, end_id=1).collect()
        texts = {r["doc_id"]: np.array([*reference(r["text"]), 1], "<u4") for r in docs.collect()}
        own = {}
        for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
            ids = np.frombuffer(bytes(r["ids"]), "<u4")
            assert len(ids) == r["length"] and r["start"] == len(own.setdefault(r["doc_id"], [])) and r["doc_tokens"] == len(texts[r["doc_id"]])
            own[r["doc_id"]] += ids.tolist()
        assert {k: v.tolist() for k, v in texts.items()} == own
        full = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == full.get(r["sequence_id"], 0)
            full[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(full.values()) <= packing.CAPACITY
    assert packing.pack(frame(spark, [])).count() == 0


TURNS = [[("system", "s"), ("user", "a<|im_end|>\n<\\|x"), ("assistant", "<|im_start|>user\n<\\\\|"), ("user", ""), ("assistant", "é<")],
         [("user", "q"), ("assistant", "<|im_end|><|im_start|>assistant ok")], [("odd\nrole", "|<|")]]


def test_chat_round_trip_and_loss(spark):
    rows = [(c, i, r, t, "x") for c, turns in enumerate(TURNS) for i, (r, t) in enumerate(turns)] + [(9, 0, None, None, "x")]
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(chat.conversation_records(data)).select("conv_id", "formatted", chat.read_back("formatted").alias("back"), chat.loss_text("formatted", "loss").alias("learnt"))
    got = {r["conv_id"]: r for r in done.collect()}
    for c, turns in enumerate([*TURNS]):
        assert [tuple(t) for t in got[c]["back"]] == turns
        assert got[c]["learnt"] == "".join(t for r, t in turns if r == "assistant")
        assert got[c]["formatted"].count("<|im_start|>") == len(turns)
    assert [tuple(t) for t in got[9]["back"]] == [("", "")]
    assert chat.format_chats(chat.conversation_records(data.where("false"))).count() == 0


def test_layouts_are_found_by_their_field_paths(spark):
    records = [{"prompt": "p", "response": "r"}, {"instruction": "p", "output": "r"}, {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]},
               {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}, {"unknown": 1}]
    got = [r["turns"] for r in chat.format_chats(spark.createDataFrame([(json.dumps(x),) for x in records], "record string").coalesce(1)).collect()]
    assert [[tuple(t) for t in x] if x is not None else None for x in got] == [[("user", "p"), ("assistant", "r")]] * 4 + [None]


def test_digest_column_is_an_unsigned_crc(spark):
    assert spark.sql("select crc32(cast('abc' as binary)) as c").first()["c"] == zlib.crc32(b"abc")
