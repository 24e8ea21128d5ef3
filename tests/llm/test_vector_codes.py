"""Vector codes against a plain integer k-means, and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from meterloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code int, error int, v int"


def plain(rows, parts, entries=16, rounds=6):
    """``{place: (code, error)}`` and the codebooks, with Python integers; ``rows`` are (id, vector) in order of (id, vector)."""
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v in rows]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[list(cut[e][p]) for e in range(min(entries, len(cut)))] for p in range(parts)]

    def choose(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            taken = {}
            for v in cut:
                taken.setdefault(choose(v[p], books[p])[1], []).append(v[p])
            for e, own in taken.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[choose(v[p], books[p]) for p in range(parts)] for v in cut]
    return [(bytes(e for _, e in f), sum(d for d, _ in f)) for f in found], books


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 3) for i, v, label in rows], SCHEMA)


def test_random_vectors_with_hot_values_and_labels(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 24))
    rows = [(int(i), [0.0] * 24 if i % 3 == 0 else (centres[i % 5] + rng.normal(scale=0.2, size=24)).astype(np.float32).tolist(), None if i % 2 else int(i % 4)) for i in rng.permutation(300)]
    codes, books = vector_codes.compress(frame(spark, rows).repartition(5), parts=8)
    want, plain_books = plain(sorted((i, v) for i, v, _ in rows), 8)
    got = {r["id"]: r for r in vector_codes.label_errors(codes).collect()}
    assert [(bytes(got[i]["code"]), got[i]["error"]) for i in range(300)] == want
    assert books.sha256() == hashlib.sha256(",".join(str(x) for book in plain_books for e in book for x in e).encode()).hexdigest()
    label = {i: k for i, _, k in rows}
    for i in range(300):
        assert got[i]["label_error"] == sum(want[j][1] for j in range(300) if label[j] == label[i])
    assert vector_codes.restore(got[1]["code"], books) == [x / 4096 for p, e in enumerate(got[1]["code"]) for x in plain_books[p][e]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5, -0.25], 1), (3, [0.5, -0.25], 1), (3, [-0.00001, 1.0], None), (None, [2.0, 2.0], 1), (9, [-1.5, 0.3], None)]
    bad = [(1, None, 1), (2, [], 1), (2, [1.0, None], 1), (2, [nan, 1.0], 1), (2, [1.0, inf], 1), (4, [1.0, 2.0, 3.0], 1), (5, [3e38, 1.0], 1)]
    codes, books = vector_codes.compress(frame(spark, good + bad), parts=2, entries=16)
    rows = codes.collect()
    assert sorted(str(r["id"]) for r in rows) == ["3", "3", "3", "9", "None"]
    assert all(r["error"] == 0 for r in rows) and books.entries.shape == (5, 2)
    assert books.entries[0].tolist() == [-1, 4096]
    same = [bytes(r["code"]) for r in rows if r["id"] == 3]
    assert sorted(same.count(c) for c in same) == [1, 2, 2]
    for empty in (frame(spark, bad[:3]), frame(spark, [])):
        codes, books = vector_codes.compress(empty)
        assert vector_codes.label_errors(codes).count() == 0 and books.entries.size == 0


def test_parts_must_fit(spark):
    with pytest.raises(ValueError):
        vector_codes.compress(frame(spark, [(1, [1.0, 2.0, 3.0], 0)]), parts=2)


def test_blocks_of_any_size_give_the_same_codes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    data = frame(spark, [(i, rng.normal(size=8).tolist(), 0) for i in range(100)])
    want = {r["id"]: (bytes(r["code"]), r["error"]) for r in vector_codes.compress(data)[0].collect()}
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    assert {r["id"]: (bytes(r["code"]), r["error"]) for r in vector_codes.compress(data.repartition(9))[0].collect()} == want
