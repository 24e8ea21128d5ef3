"""Encoding with forced boundaries equals the tokenizers library on every text; decoding equals it on every list of ids."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from meterloom.llm import bpe
from meterloom.llm.byte_words import blocks
from meterloom.llm.queries import QUERIES
from meterloom.llm.tokens import default_tokenizer

NASTY = [*" \n\t'\r  sdtmrvle.,!?-_0123ABCzé日本語　\xa0\x85ñß🙂‍́\x1c\x00|<>", "<|endoftext|>", "'ll", "'s", "'re", "  ", "\n\n", " the", "ing"]
ODD = [(5, "héllo <|endoftext|><|endoftext|> wörld<|endoftext"), (1, None), (2, ""), (None, " "), (7, "don't\r\n\n  x"), (7, "don't\r\n\n  x"),
       (9, "a" * 50_000), (8, "word     日本語 'tis　 " * 20_000), (3, "\u0085 x\xa0\xa0y")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids_of(cuts, texts):
    for a, b, data, limits in blocks(pa.array(texts, pa.string()), 1 << 16):
        ids, first = cuts.block(data, limits)
        yield from (ids[x:y].tolist() for x, y in zip(first, first[1:]))


def test_random_texts_and_characters(library):
    rng, cuts = random.Random(3), bpe.ForcedCuts(default_tokenizer())
    assert cuts.exact and cuts.apart.mean() > 0.5
    texts = ["".join(rng.choices(NASTY, k=rng.randrange(40))) for _ in range(20_000)]
    some = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(rng.randrange(0xE000, 0x110000)) for _ in range(5_000)]
    texts += [f"a {c}b {c}{c} 1{c}2'{c}s  {c}\n{c}x'{c}" for c in some]
    for text, got in zip(texts, ids_of(cuts, texts), strict=True):
        assert got == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pairs_marked_apart_are_inside_no_token():
    cuts = bpe.ForcedCuts(default_tokenizer())
    for token in bpe.vocabulary(default_tokenizer()).to_pylist()[:50_256]:
        for x, y in zip(token, token[1:]):
            assert not cuts.apart[x * 256 + y]


def test_small_tables_of_fragments_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "FRAGMENTS", 50)
    texts = [t or "" for _, t in ODD] * 3
    assert list(ids_of(bpe.ForcedCuts(default_tokenizer()), texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    cuts, plain = bpe.ForcedCuts(path), Tokenizer.from_file(path)
    assert not cuts.exact
    texts = ["Hello, World! don't", "", "  x  "]
    assert list(ids_of(cuts, texts)) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ODD], "doc_id long, text string, ids string, n_tokens int, decoded string")


def test_odd_rows(odd, library):
    rows = bpe.encode(odd).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"])) for r in rows)
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), np.array(ids, "<u4").tobytes()))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(odd)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(i), t or "") for i, t in ODD)
    assert bpe.encode(odd.where("false")).count() == bpe.decode(bpe.encode(odd.where("false"))).count() == 0


def test_ids_keep_their_type(spark):
    named = spark.createDataFrame([("k1", "a b"), (None, None)], "key string, body string")
    assert bpe.encode(named, id_col="key", text_col="body").dtypes[0] == ("key", "string")
    assert {r["key"]: r["n_tokens"] for r in bpe.encode(named, id_col="key", text_col="body").collect()} == {"k1": 2, None: 0}


def test_decoding_any_ids(spark, library):
    rng = random.Random(1)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(500)]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)] + [(-1, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows).collect()}
    assert got.pop(-1) == ""
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_query_equals_the_library(spark, sf_documents, library):
    got = {r["doc_id"]: r for r in QUERIES["op12_bpe"](spark, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in sf_documents.select("doc_id", F.col("text")).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
