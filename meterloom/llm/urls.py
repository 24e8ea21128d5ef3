"""URL filters: fixed host and path rules, and logistic regression on hashed character n-grams for all other URLs.

The classifier is trained from a small labelled URL table: the caller's (``url, blocked``), or :func:`labelled_urls`, whose hosts are made
of general topic words, of words that say nothing, and of invented names, in several shapes and under several top-level domains;
shapes, domains, paths and modifiers are the same for both verdicts, so only topic words tell them apart. A quarter of its names
is never trained on (:func:`withheld`) and measures the classifier. Features are the distinct n-grams of 3 to 5 characters
of host and path, hashed; training and scoring are MLlib's.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there to ``?``, ``#`` or the end. A
null URL or one without ``://`` has neither and gets the verdict of the classifier on an empty text. A rule fits its host and
all subdomains if the path starts with the rule's path; the longest wins. Each row is judged alone, so repeated rows get
equal verdicts; an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

import random
import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm.tables import whole_row

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
FEATURES = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Topic words of sites that filters block: gambling, drugs by mail, adult, piracy, fraud, advertising.
BLOCKED_WORDS = """casino poker roulette slots jackpot betting bets gamble gambling lottery bingo wager blackjack sportsbook spins
 pills viagra cialis pharma steroids painkiller slimming dietpill
 porn xxx nude escort singles hookup camgirl fetish
 warez crack keygen torrent cracked nulled serials pirate
 phishing malware trojan spyware ransom payday loan forex doubler cashback getrich moneymaker replica counterfeit
 adserver adclick popunder banner clickbait tracker spam linkfarm prize giveaway sweepstake jackpots bonus""".split()
#: Topic words of other sites.
ALLOWED_WORDS = """news library museum university weather recipes garden history science council school football theatre cinema books
 travel railway hospital chess astronomy physics journal archive forum docs wiki music gallery nature kitchen maps energy training
 writing machine english health earth north academy biology bridge camera castle chemistry climate coffee college concert culture
 design dictionary economy engine farming fashion finance fishing florist forest geology grammar hiking hotel island justice language
 lecture medicine mountain novel ocean opera orchestra painting parish piano poetry politics quarry radio river sailing sculpture software
 station statistics surgery tennis textile tourism traffic village violin volcano wildlife workshop""".split()
#: Words of both kinds of names.
_MODIFIERS = ["", "best", "online", "mega", "my", "top", "the", "pro", "club", "world", "royal", "free", "hot", "quick", "city", "first"]
_ENDINGS = ["com", "org", "net", "io", "info", "co.uk", "de", "fr", "es", "ru", "biz", "tk", "example.com", "example.org"]
_FRONTS = ["", "www.", "m.", "blog."]
_PATHS = ["/", "/en/12", "/de/7.html", "/fr/431/", "/es/96", "/article/2021/03", "/index.php"]
INVENTED = 600


def withheld(name: str) -> bool:
    """Whether a name is kept out of training."""
    return zlib.crc32(name.encode()) % 4 == 0


def labelled_urls(held_out: bool = False, seed: int = 5) -> list[tuple[str, int]]:
    """``(url, blocked)``: a few thousand rows made by rule, of the trained names or of the withheld ones."""
    rng = random.Random(seed)
    names = []
    for words, blocked in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for word in words:
            for modifier in rng.sample(_MODIFIERS, 8 if blocked else 5):
                joint = rng.choice(["", "-"]) if modifier else ""
                names.append((modifier + joint + word if rng.random() < 0.7 else word + joint + modifier, blocked))
    for _ in range(INVENTED):  # names that mean nothing are no sign of anything
        word = "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "th", "en", "on", "ing", "er"]) for _ in range(rng.randint(2, 4)))
        names.append((word, 0))
    out = []
    for name, blocked in names:
        url = f"https://{rng.choice(_FRONTS)}{name}.{rng.choice(_ENDINGS)}{rng.choice(_PATHS)}"
        if withheld(name) == held_out:
            out.append((url, blocked))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return (F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: len(r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def ngrams(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Distinct character n-grams of a text that is framed by spaces."""
    framed = F.concat(F.lit(" "), text, F.lit(" "))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - n + 1, F.lit(1)))
        grams = F.transform(starts, lambda i: F.substring(framed, i, F.lit(n)))
        return F.when(F.length(framed) >= n, grams).otherwise(F.array().cast("array<string>"))

    grams = [of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*grams))


def _features(df: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    grams = df.withColumn("grams", F.concat(F.transform(ngrams(host), lambda g: F.concat(F.lit("h"), g)), F.transform(ngrams(path), lambda g: F.concat(F.lit("p"), g))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams)


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None, reg: float = 0.01) -> LogisticRegressionModel:
    """Fits the classifier on a small table of ``(url, blocked)``."""
    table = spark.createDataFrame(labelled or labelled_urls(), "url string, blocked int").coalesce(1)
    fitted = LogisticRegression(featuresCol="features", labelCol="blocked", regParam=reg, maxIter=60)
    return fitted.fit(_features(table))


def judge(pages: DataFrame, model: LogisticRegressionModel | None = None, rules: list[tuple[str, str]] = RULES,
          url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``row`` (all columns of ``pages``) with ``host, path, rule, score, verdict``; the score is the classifier's for every row."""
    model = model or train(pages.sparkSession)
    rows = pages.select(whole_row(pages).alias("row"), F.col(url_col).alias("url"))
    scored = model.transform(_features(rows))
    host, path = host_and_path(F.col("url"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    out = scored.select("row", host.alias("host"), path.alias("path"), vector_to_array("probability")[1].alias("score"))
    return out.select("row", "host", "path", rule.alias("rule"), "score", F.coalesce(
        verdict, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
