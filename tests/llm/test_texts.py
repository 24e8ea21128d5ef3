"""Toxicity, quality rules, URL filter and mixing: held-out accuracy, brute force, defined results for odd rows."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from meterloom.llm import mixing, quality, toxicity, urls

SCHEMA = "doc_id long, text string, row string, id string, source string, score string, kept string, rate int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j k"), (5, "a b c d e " * 400), (5, "a b c d e " * 400),
       (6, "# $ 5% <x>\nsame line here\nsame line here\n\n"), (7, "ünï cödé   words, more of them than ten in this one line."), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "x", ("hot" if (i or 0) % 3 else None), "s", "k", 1) for i, t in rows], SCHEMA)


def test_quality_matches_brute_force(spark, sf_documents):
    def base(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {i + j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
                len(w) < 10 or 100 * len(inside) > 20 * len(w))

    for docs in (frame(spark, ODD), sf_documents):
        got = Counter((r["doc_id"], *list(r)[1:7]) for r in quality.quality(docs).collect())
        assert got == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())


def test_quality_rejects_what_loses_too_much(spark):
    good = "This is a sentence with a number of words that ends as it should.\n"
    found = {r["doc_id"]: r for r in quality.quality(frame(spark, [(1, good), (2, "Home | About | Contact | Login | Register | Help | Terms | Privacy | Cart | More\n")])).collect()}
    assert found[1]["kept"] and found[1]["failed_lines"] == [] and found[1]["clean_text"] == good
    assert not found[2]["kept"] and 0 in found[2]["failed_lines"]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hit = sum(t and p for t, p in held)
    # Measured: 110 of 144 toxic texts found, 1 of 1200 clean ones flagged. A text without any known sign is not found.
    assert hit >= 0.7 * sum(t for t, _ in held) and hit >= 0.95 * sum(p for _, p in held)


def test_toxicity_never_reads_held_out_labels(spark, sf_documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(sf_documents, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 0), (None, 1)], "doc_id long, toxic int")
    none = labels.where("false")
    for table in (labels, none):
        got = toxicity.toxicity(frame(spark, ODD), table).collect()
        assert len(got) == len(ODD) and all(r["score"] is not None for r in got)
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0
    kept = toxicity.keep_clean(frame(spark, ODD), none)
    assert kept.columns == frame(spark, []).columns


def test_url_filter_matches_brute_force(spark):
    given = [None, "", "no scheme", "http://", "http://example.net", "http://a.EXAMPLE.net/en/x?q=1", "https://www.example.net/de/", "https://notexample.com/de/",
             "https://example.com/de/1#f", "https://x.org/fr/a", "https://x.org?fr/", "ftp://some.net#x", "http://ÄÉ.net/A/B", "http://example.com/de"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def rule(host, path):
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    pages = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in enumerate(given)], "page_id long, url string, host string, path string, score double")
    got = {r["row"]["page_id"]: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(given):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, name), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
    assert urls.judge(pages.where("false")).count() == 0


def test_mixing_reaches_target_weights(spark):
    rows = [(i, "x" * 9, ("a" if i % 10 else "b")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["source"]: r for r in mixing.source_rates(docs, weights={"a": 1, "b": 1}).collect()}
    assert abs(rates["a"]["rate"] - 5 / 9) < 1e-9 and abs(rates["b"]["rate"] - 5) < 1e-9
    got = mixing.mix(docs, weights={"a": 1, "b": 1}, seed=3)
    count = Counter(r["source"] for r in got.collect())
    assert abs(count["a"] / 2000 - 1) < 0.1 and abs(count["b"] / 2000 - 1) < 0.1
    key = lambda d: sorted((r["id"], r["copy"], r["place"]) for r in d.collect())
    assert key(got) == key(mixing.mix(docs.repartition(7), weights={"a": 1, "b": 1}, seed=3))
    assert key(got) != key(mixing.mix(docs, weights={"a": 1, "b": 1}, seed=4))


def test_mixing_odd_rows(spark):
    got = mixing.mix(frame(spark, ODD), temperature=1.0)
    assert got.select("row.*").columns == frame(spark, []).columns
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, ODD), weights={"absent": 1.0}).count() == 0


def test_url_classifier_on_names_it_was_not_trained_on(spark):
    held = urls.labelled_urls(held_out=True)
    trained = {u for u, _ in urls.labelled_urls()}
    assert len(held) > 300 and not trained & {u for u, _ in held} and len(trained) > 1000
    pages = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(held)], "page_id long, url string, truth int")
    rows = urls.judge(pages, rules=[]).select("row.truth", (F.col("verdict") == "block").cast("int").alias("p")).collect()
    hit, said, true = sum(r["truth"] * r["p"] for r in rows), sum(r["p"] for r in rows), sum(r["truth"] for r in rows)
    assert hit >= 0.9 * true and hit >= 0.9 * said, (hit, said, true)
    spam = ["mega-gamble.co.uk", "onlinegambling.io", "luckyspins.biz", "hot-singles.ru", "phishing-login.tk"]
    plain = ["thering.example.org", "thernt.example.com", "ththon.example.org", "bookshelf.de", "cityweather.fr"]
    both = spark.createDataFrame([(i, f"https://{h}/en/4") for i, h in enumerate(spam + plain)], "page_id long, url string")
    got = {r["row"]["page_id"]: r["verdict"] for r in urls.judge(both, rules=[]).collect()}
    assert [got[i] for i in range(10)] == ["block"] * 5 + ["allow"] * 5


def test_urls_repeated_and_very_long(spark):
    long_url = "https://news.example.org/" + "a" * 50_000
    pages = spark.createDataFrame([(1, long_url, "x"), (1, long_url, "x"), (2, None, "y"), (3, "no scheme", "y")], "page_id long, url string, host string")
    got = sorted((r["row"]["page_id"], r["host"], len(r["path"]), r["verdict"]) for r in urls.judge(pages).collect())
    assert got[0] == got[1] and got[0][:3] == (1, "news.example.org", 50_001) and [g[1:3] for g in got[2:]] == [("", 0), ("", 0)]
