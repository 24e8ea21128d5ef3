"""Line deduplication against a plain aligner that holds all documents in memory."""

import random

import pytest
from pyspark.sql import functions as F

from meterloom.llm import line_dedup

BLANK = " \t\n\v\f\r"
SCHEMA = "doc_id long, text string, removed int, clean_text string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], SCHEMA).repartition(3)


def plain(rows, marks, min_words, rare):
    """``{(id, text): (removed, partners)}``; ``marks`` gives the hash that orders texts of one id."""
    docs = sorted({(i, marks[t or ""], t or "") for i, t in rows if i is not None})
    lines = [[(k, x.strip(BLANK)) for k, x in enumerate(t.split("\n")) if x.strip(BLANK)] for _, _, t in docs]
    size = lambda x: len(x.split())
    holders = {}
    for d, own in enumerate(lines):
        for i in range(len(own)):
            words, j = 0, i
            while j < len(own) and words < min_words:
                words += size(own[j][1])
                j += 1
            if words >= min_words:
                held = holders.setdefault(tuple(x for _, x in own[i:j]), [])
                if d not in held:
                    held.append(d)
    pairs = set()
    for held in holders.values():
        pairs |= {(d, e) for d in held for e in held if e < d} if len(held) <= rare else {(d, held[0]) for d in held[1:]}
    gone = {}
    for d, e in pairs:
        where = [{}, {}]
        for side, own in zip(where, (lines[d], lines[e])):
            for n, (_, x) in enumerate(own):
                side.setdefault(x, []).append(n)
        aligned = line_dedup.patience([(where[0][x], where[1][x]) for x in where[0] if x in where[1]])
        i = 0
        while i < len(aligned):
            j = i + 1
            while j < len(aligned) and aligned[j] == (aligned[j - 1][0] + 1, aligned[j - 1][1] + 1):
                j += 1
            if sum(size(lines[d][n][1]) for n, _ in aligned[i:j]) >= min_words:
                for n, _ in aligned[i:j]:
                    place = gone.setdefault(d, {})
                    place[lines[d][n][0]] = min(place.get(lines[d][n][0], e), e)
            i = j
    return {(i, t): (sorted(gone.get(d, {})), sorted({docs[e][0] for e in gone.get(d, {}).values()})) for d, (i, _, t) in enumerate(docs)}


def check(spark, rows, **options):
    texts = spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string")
    marks = {r["t"]: r["m"] for r in texts.select("t", line_dedup.text_mark(F.col("t")).alias("m")).collect()}
    want = plain(rows, marks, options.get("min_words", line_dedup.MIN_WORDS), options.get("rare", line_dedup.RARE))
    found = line_dedup.deduplicate_lines(frame(spark, rows), **options).collect()
    assert sorted(((r["id"], r["row"]["text"]) for r in found), key=str) == sorted(rows, key=str)
    for r in found:
        text = r["row"]["text"] or ""
        removed, partners = want.get((r["id"], text), ([], []))
        assert (r["removed"], r["partners"]) == (removed, partners), (r["id"], text)
        assert r["clean_text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(removed))
    return {(r["id"], r["row"]["text"]): r["clean_text"] for r in found}


def test_a_third_holder_of_one_line_breaks_no_pair(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    got = check(spark, [(1, a), (2, f"{a}\n{b}"), (3, f"head\n{a}\n{b}")])
    assert got[3, f"head\n{a}\n{b}"] == "head"


def test_texts_that_share_an_id_lose_nothing_of_their_own(spark):
    block = "a block of ten words that the first document holds"
    got = check(spark, [(1, block), (2, f"{block}\nmore of two"), (2, "unique first line of other text"), (2, f"{block}\nmore of two")])
    assert got[2, "unique first line of other text"] == "unique first line of other text"
    assert got[2, f"{block}\nmore of two"] == "more of two"


@pytest.mark.parametrize("rare", [1, 2, 4])
def test_random_documents_with_many_holders_of_each_line(spark, rare):
    rng = random.Random(rare)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 3, 5, 9]))) for _ in range(18)] + ["", "  ", "\t"]
    rows = [(rng.randrange(40), "\n".join(rng.choice(["", " "]) + rng.choice(pool) for _ in range(rng.randrange(14)))) for _ in range(70)]
    rows += [(None, rows[3][1]), (99, None), (98, ""), (97, "\n\n"), rows[5], rows[6]]
    rows += [(200 + i, "\n".join(pool[2:9])) for i in range(12)] + [(300 + i, "\n".join([pool[4], *pool[9:14], str(i)])) for i in range(9)]
    check(spark, rows, rare=rare, min_words=8)
    check(spark, rows, rare=rare, min_words=1)


def test_very_long_lines_and_texts(spark):
    long_line, many = "word " * 40_000, "\n".join(f"line {i} of a long text with some more words" for i in range(5_000))
    got = check(spark, [(1, long_line), (2, f"x\n{long_line}"), (3, many), (4, f"{many}\nend of four"), (5, "\n".join(reversed(many.split("\n"))))])
    assert got[2, f"x\n{long_line}"] == "x" and got[4, f"{many}\nend of four"] == "end of four"


def test_ids_keep_their_type(spark):
    rows = spark.createDataFrame([("b", "the same eight words stand in both of them"), ("a", "the same eight words stand in both of them")], "key string, body string")
    got = {r["id"]: r["clean_text"] for r in line_dedup.deduplicate_lines(rows, id_col="key", text_col="body").collect()}
    assert got == {"a": "the same eight words stand in both of them", "b": ""}


def test_longest_rising_run():
    rng = random.Random(1)
    for _ in range(300):
        values = [rng.randrange(12) for _ in range(rng.randrange(9))]
        best = max((sum(1 for _ in c) for m in range(1 << len(values)) for c in [[v for i, v in enumerate(values) if m >> i & 1]] if all(x < y for x, y in zip(c, c[1:]))), default=0)
        run = [values[i] for i in line_dedup.rising(values)]
        assert len(run) == best and all(x < y for x, y in zip(run, run[1:]))
