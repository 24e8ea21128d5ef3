"""Exact, near and line deduplication against brute force, and their defined results for odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from meterloom.llm import exact_dedup, line_dedup, near_dedup

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, row string, id string, keep_id int, n_shingles string, run int, source string"
SPACE = r"[\x20\x09-\x0D]+"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "r", "x", 7, "s", 1, None) for i, t in pairs], SCHEMA)


def odd_rows():
    base = " ".join(WORDS[:60])
    near = " ".join(WORDS[:57] + ["changed", *WORDS[58:60]])
    return [
        (5, base), (3, base.replace(" ", "\t\n ")), (9, near), (1, None), (2, ""), (4, " \n "), (8, "word"), (11, "word"),
        (12, "Two Words"), (13, "two words"), (20, " ".join(WORDS[100:] * 40)), (21, " ".join(WORDS[100:] * 40) + " end"), (22, "é ü   ß"), (22, "é ü   ß"),
    ]


@pytest.mark.parametrize("runs,fan_bits", [(4096, 4), (4, 1)])
def test_exact_matches_brute_force(spark, runs, fan_bits):
    rows = odd_rows()
    plain = [re.sub(SPACE, " ", t or "", flags=re.ASCII) for _, t in rows]
    want = sorted((i, min(j for (j, _), q in zip(rows, plain) if q == p), plain.count(p), i == min(j for (j, _), q in zip(rows, plain) if q == p),
                   hashlib.sha256(p.encode()).hexdigest()) for (i, _), p in zip(rows, plain))
    got = sorted(tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows), runs=runs, fan_bits=fan_bits).collect())
    assert got == want
    kept = exact_dedup.deduplicate(frame(spark, rows), runs=runs, fan_bits=fan_bits)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[0] for w in want if w[3]})


def shingle_set(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    name = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((name[a], name[b]))
                name = {i: x if n == y else n for i, n in name.items()}
    return sorted((i, len(sets[i]), name[i], i == name[i]) for i, _ in rows)


@pytest.mark.parametrize("k", [2, 5])
def test_near_matches_brute_force(spark, k):
    rows = odd_rows()
    for f in range(6):  # families: copies with one to four words changed
        own = [WORDS[(f * 53 + j * (f + 3)) % 400] for j in range(80)]
        for c in range(8):
            text = list(own)
            for e in range(c % 4):
                text[(11 * e + 7 * c) % 80] = f"new{f}{c}{e}"
            rows.append((1000 + 10 * f + c, " ".join(text)))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows), k=k).collect())
    assert got == brute_components(rows, k, 80)


def test_near_on_documents_matches_brute_force(spark, sf_documents):
    rows = [(r["doc_id"], r["text"]) for r in sf_documents.collect()]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(sf_documents, k=5).collect())
    assert got == brute_components(rows, 5, 80)


def test_near_keeps_one_of_each_group_and_all_columns(spark):
    kept = near_dedup.deduplicate(frame(spark, odd_rows()), k=5)
    assert kept.columns == frame(spark, []).columns
    want = {w[0] for w in brute_components(odd_rows(), 5, 80) if w[3]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "only here with no id")]
    exact = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert exact == {(None, 4), (4, 4), (None, None)}
    near = near_dedup.near_duplicates(frame(spark, rows), k=2).collect()
    assert sorted((str(r["doc_id"]), r["kept"]) for r in near) == [("4", True), ("None", True), ("None", True)]


def test_patience_aligns_moved_and_repeated_lines():
    assert line_dedup.patience([([0], [3]), ([1], [4]), ([2], [5]), ([5], [9])]) == [(0, 3), (1, 4), (2, 5), (5, 9)]
    # The moved card leaves the rising run; the repeated line is matched in order, between the cards around it.
    assert line_dedup.patience([([0], [9]), ([1], [0]), ([4], [3]), ([2, 3, 7], [1, 2, 4, 8])]) == [(1, 0), (2, 1), (3, 2), (4, 3), (7, 4)]
    assert line_dedup.rising([5, 1, 2, 9, 3]) in ([1, 2, 4], [1, 2, 3])


def test_line_dedup_deletes_common_blocks_from_the_later_document(spark):
    block = "this line is shared by both of the documents here\nand so is this one right after the first"
    short = "see also"
    rows = [(1, f"opening of one\n{block}\nclosing of one\n{short}"), (2, f"opening of two\n{block}\nclosing of two\n{short}"),
            (3, f"alone\n\n{block}"), (4, None), (5, ""), (6, "\n\n"), (None, block)]
    found = {r["id"]: r for r in line_dedup.deduplicate_lines(frame(spark, rows)).collect()}
    assert found[1]["clean_text"] == rows[0][1] and found[1]["removed"] == []
    assert found[2]["clean_text"] == f"opening of two\nclosing of two\n{short}"
    assert (found[2]["removed"], found[2]["partners"]) == ([1, 2], [1])
    assert found[3]["clean_text"] == "alone\n"
    assert [found[i]["clean_text"] for i in (4, 5, 6, None)] == ["", "", "\n\n", block]
    assert found[2]["row"]["keep_id"] == 7


def test_line_dedup_of_documents_that_repeat_a_line_many_times(spark):
    line = "the very same line stands here over and over again"
    rows = [(i, "\n".join([f"head {i}", *[line] * 3000, f"tail {i}"])) for i in range(1, 5)]
    found = {r["id"]: r for r in line_dedup.deduplicate_lines(frame(spark, rows)).collect()}
    assert found[1]["clean_text"] == rows[0][1]
    assert all(found[i]["clean_text"] == f"head {i}\ntail {i}" and found[i]["partners"] == [1] for i in (2, 3, 4))


def test_line_dedup_leaves_one_copy_of_each_line(spark, sf_documents):
    found = line_dedup.deduplicate_lines(sf_documents).collect()
    before = {x.strip(" \t\n\v\f\r") for r in found for x in (r["row"]["text"] or "").split("\n")}
    after = {x.strip(" \t\n\v\f\r") for r in found for x in r["clean_text"].split("\n")}
    assert before - {""} == after - {""}
    assert sum(len(r["removed"]) for r in found) > 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.deduplicate(none).count() == 0
    assert line_dedup.deduplicate_lines(none).count() == 0


def test_runs_are_merged_in_the_order_of_their_digests(spark, sf_documents):
    digests = exact_dedup.with_digest(sf_documents.repartition(8)).withColumn("run", F.spark_partition_id())
    winners = exact_dedup.merge_runs(digests, runs=64, fan_bits=2)
    plan = winners._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 6 and "HashAggregate" not in plan  # three rounds, each before and after the shuffle
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = winners.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.hex("digest").alias("d"), "keep_id").collect()  # all columns: without the ids nothing is left to merge
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for p in {r["p"] for r in parts}:
        own = [r["d"] for r in parts if r["p"] == p]
        assert own == sorted(own) and len(own) > 1
