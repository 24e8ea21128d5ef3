"""Ranked lexical search against plain scoring of every document, with and without first thresholds."""

import math
import random
import re

import numpy as np
import pytest

from meterloom.llm import lexical

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    split = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = {}
    for _, t in split:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    joined = {}
    for item, text in items:
        joined.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in joined.items():
        found = []
        for i, t in split:
            if not t:
                continue
            m = 50 + (50 * len(t) * n_docs) // n_terms
            score = 0
            for x in wanted:
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t in docs], "doc_id long, text string, rank string, score double, terms string").repartition(5),
            spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, place int"))


def rows(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


WORDS = ["a", "Be", "cé", "日本", "x1", "the", "THE", "of", "on-line", "z", "été", "q_r", "42", "w9"]


@pytest.mark.parametrize("seed_rows", [20_000, 40])
@pytest.mark.parametrize("bits", [1, 3, 11])
def test_equals_plain_scoring(spark, monkeypatch, seed_rows, bits):
    # Few coordinates make loose bounds, many ties and long documents test the order.
    monkeypatch.setattr(lexical, "SEED_ROWS", seed_rows)
    monkeypatch.setattr(lexical, "STEP", 4)
    rng = random.Random(bits)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 3, 8, 40])))) for i in rng.sample(range(5000), 400)]
    docs += [(6000 + i, "the same copy of a text") for i in range(120)]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(6)))) for i in range(12)] + [(50, "same copy"), (51, "absent words only")]
    for k in (1, 7):
        assert rows(lexical.search(*frames(spark, docs, items), k=k, bits=bits)) == plain(docs, items, k)


def test_odd_rows(spark):
    docs = [(4, "alpha beta"), (4, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (5, "… !"), (9, "alpha " * 70_000 + "beta"), (1, "gamma"), (-7, "alpha beta")]
    items = [(1, "Alpha"), (1, "gamma"), (None, "beta"), (2, None), (3, "...")]
    assert rows(lexical.search(*frames(spark, docs, items), k=5)) == plain(docs, items, 5)
    for d, i in ((docs, []), ([], items), ([(1, None)], items)):
        out = lexical.search(*frames(spark, d, i))
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_items_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    docs = [(i, " ".join(WORDS[i % 9 : i % 9 + 4])) for i in range(60)]
    items = [(i, " ".join(WORDS[i : i + 3])) for i in range(7)]
    assert rows(lexical.search(*frames(spark, docs, items), k=3)) == plain(docs, items, 3)


def test_no_document_scores_above_its_bound():
    rng = np.random.default_rng(0)
    h = np.unique(rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    count = rng.integers(1, 600, len(h))
    weights = rng.integers(0, 9000, len(h))
    sketch = lexical.sketches(np.zeros(len(h), np.int64), h, count, 1, 4)
    items = [np.sort(rng.choice(h, 30, replace=False)) for _ in range(20)]
    search = lexical.Searcher(items, h, weights, 100, 4000, 5, 4, np.zeros(20, np.int64))
    length = np.array([130])
    exact = [(weights[p] * lexical.impact(count[p], length)).sum() for p in search.places]
    assert np.all(search.bounds(sketch, length)[0] >= exact)


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [(r["rank"], r["doc_id"]) for r in lexical.search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
