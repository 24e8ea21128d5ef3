"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. **Voters.** A fixed lexicon, patterns (shouting, masked words, insults in the second person), and :data:`SHARDS` lexicons of
   words and word beginnings that labelled training rows show almost only in toxic texts. Near copies among the training
   rows count once there, so a copied text cannot make its rare words look like a sign. Every voter says hit or no hit.
2. **Label model.** Over all rows that are not held out, a two-class latent model gives each voter's hit rates in either class
   by EM, without labels, from the counts of vote patterns. Correlations of each pair of voters inside a class discount
   their votes: a voter that agrees with others beyond what the class explains counts for less.
3. **Classifier.** Logistic regression on the induced words and the votes, trained on the posterior of a bounded sample.

Labels are read for training rows only: those whose ``crc32(id as text) % 3`` is not 1. At most :data:`SAMPLE` labelled rows (in
hash order) induce lexicons and at most :data:`SAMPLE` rows train the classifier; vote counts cover all rows, and whole texts
are read everywhere. Only lexicons, at most ``2**voters`` pattern counts and these samples reach the driver.

Defined results: null text counts as empty and gets the score of a text without hits; a null id is not held out and never
trains; rows that repeat an id are scored each; without labels, or with one class only, the fixed voters remain; an empty table
gives an empty result; further columns are passed through by :func:`keep_clean`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.llm.byte_words import Words, blocks, mix64
from meterloom.llm.tables import whole_row
from meterloom.session import materialise

SAMPLE = 20_000
SHARDS = 6
MIN_SUPPORT, MAX_FEATURES, CANDIDATES = 5, 4096, 30_000
THRESHOLD = 0.7
STEMS = (4, 5, 6)
#: General words of insult, four languages.
LEXICON = frozenset("""
idiot idiots moron morons stupid imbecile loser losers scum trash worthless pathetic disgusting clown clowns jerk vermin filthy dumbass
trottel versager abschaum widerlich ekelhaft schwachkopf erbärmlich dummkopf
imbécile crétin abruti connard minable ordure débile dégoûtant
idiota estúpido imbécil asqueroso patético payaso escoria
""".split())
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[^\w]+){4,}"),
    "masked": re.compile(r"\b[A-Za-z]\*{2,}[A-Za-z]?\b"),
    "second_person": re.compile(r"\b(?:you|du|tu|vous|usted)\b[^.!?\n]{0,20}\b(?:" + "|".join(sorted(LEXICON)) + r")\b", re.I),
}
#: Hit rates that EM starts from: (toxic, clean), for lexicons and for patterns.
START_LEXICON, START_PATTERN, START_PRIOR = (0.5, 0.01), (0.2, 0.1), 0.1


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def word_features(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:n] for n in STEMS if len(word) >= n]


@dataclass
class Model:
    """Induced features with their voter, the label model and the classifier."""

    features: dict[str, int] = field(default_factory=dict)
    voter: list[int] = field(default_factory=list)
    rates: np.ndarray | None = None
    discount: np.ndarray | None = None
    prior: float = START_PRIOR
    weights: np.ndarray | None = None
    bias: float = 0.0

    @property
    def voters(self) -> int:
        return SHARDS + 1 + len(PATTERNS)


def text_hits(text: str, features: dict[str, int], voter: list[int], memo: dict[str, tuple]) -> tuple[int, dict[int, int]]:
    """``(vote bits, feature -> count)`` of one text. Bits: induced lexicons, fixed lexicon, patterns."""
    votes, counts = 0, {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        hit = memo.get(word)
        if hit is None:
            found = tuple(features[f] for f in word_features(word) if f in features)
            if len(memo) > 100_000:
                memo.clear()
            hit = memo[word] = (found, word in LEXICON)
        for f in hit[0]:
            counts[f] = counts.get(f, 0) + n
            votes |= 1 << voter[f]
        if hit[1]:
            votes |= 1 << SHARDS
    for j, pattern in enumerate(PATTERNS.values()):
        if pattern.search(text):
            votes |= 1 << (SHARDS + 1 + j)
    return votes, counts


def hit_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, votes, hits, counts`` per row: the one pass over whole texts."""
    features, voter = model.features, model.voter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                got = [text_hits(t or "", features, voter, memo) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([v for v, _ in got], pa.int32()), pa.array([list(c) for _, c in got], pa.list_(pa.int32())),
                     pa.array([list(c.values()) for _, c in got], pa.list_(pa.int32()))], ["id", "held_out", "votes", "hits", "counts"])

    return docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(
        run, docs.select(F.col(id_col).alias("id")).schema.simpleString()[7:-1].replace(":", " ") + ", held_out boolean, votes int, hits array<int>, counts array<int>")


def hashed_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``, one for each value.

    A hash threshold somewhat above the share of ``n`` goes first, so that little more than ``n`` rows are sorted or sent
    anywhere, however many rows and partitions there are.
    """
    share = (n + 10 * n**0.5 + 100) / max(1, rows.count())
    some = rows if share >= 1 else rows.where(F.xxhash64(key) < F.lit(int(-(2**63) + share * 2**64)))
    return some.dropDuplicates([key]).orderBy(F.xxhash64(key), key).limit(n)


def induce_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, int]:
    """Words and word beginnings that training rows show almost only in toxic texts, with the shard of each."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    known = materialise(hashed_sample(known, "label_id", sample), "training_labels")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, F.col("id") == F.col("label_id")).select("id", "toxic", "text")
    rows = materialise(rows, "training_texts")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, limits in blocks(batch.column(2)):
                value, first = Words(data, limits, lower=True).shingles(3)
                for x, y in zip(first[:-1], first[1:]):
                    own = value[x:y]
                    out.append([int((mix64(own + np.uint64(j)) >> np.uint64(1)).min()) for j in range(4)] if len(own) else [0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "toxic", "sketch"])

    seen: set[int] = set()
    single: set = set()
    classes = Counter()
    for r in sorted(rows.mapInArrow(sketch, "id long, toxic int, sketch array<long>").collect(), key=lambda r: r["id"]):  # at most ``sample`` rows
        if seen.isdisjoint(r["sketch"]):
            single.add(r["id"])
            classes[r["toxic"]] += 1
        seen.update(r["sketch"])
    if not classes[1] or not classes[0]:
        return {}

    def tally(of: int, only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some, n = batch.slice(at, 512), Counter()
                    for i, toxic, text in zip(*(c.to_pylist() for c in some.columns)):
                        if toxic == of and i in single:
                            own = {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}
                            n.update(own if only is None else own & only)
                    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])

        return rows.mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    positive = {r["f"]: r["n"] for r in tally(1, None).where(F.col("n") >= MIN_SUPPORT).orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()}
    negative = {r["f"]: r["n"] for r in tally(0, frozenset(positive)).collect()}
    chosen = []
    for f, n in positive.items():
        other = negative.get(f, 0)
        lift = (n / classes[1]) / ((other + 0.5) / classes[0])
        if lift >= 20 and n >= 9 * other:
            chosen.append((-n, f))
    return {f: zlib.crc32(f.encode()) % SHARDS for _, f in sorted(chosen)[:MAX_FEATURES]}


def fit_label_model(patterns: dict[int, int], voters: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """``(hit rates per voter and class, discount per voter, share of toxic rows)`` by EM on counts of vote patterns."""
    keys = np.array(list(patterns), np.int64)
    n = np.array(list(patterns.values()), np.float64)
    hit = ((keys[:, None] >> np.arange(voters)) & 1).astype(np.float64)
    start = np.array([START_LEXICON] * (SHARDS + 1) + [START_PATTERN] * (voters - SHARDS - 1))
    rates, prior, discount = start.copy(), START_PRIOR, np.ones(voters)
    anchor = 0.01 * max(n.sum(), 1.0)  # pseudo-rows at the start values keep the class the toxic one
    for step in range(rounds):
        p = _posterior(hit, rates, discount, prior)
        share = np.stack([p * n, (1 - p) * n])
        rates = ((share @ hit).T + anchor * 0.1 * start) / (share.sum(1) + anchor * 0.1)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        prior = float(np.clip((share[0].sum() + anchor * START_PRIOR) / (n.sum() + anchor), 1e-4, 0.5))
        if step == rounds // 2:
            corr = np.zeros((voters, voters))
            for c in (0, 1):
                w = share[c] / max(share[c].sum(), 1e-9)
                centred = hit - rates[:, c]
                cov = (centred * w[:, None]).T @ centred
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr += cov / np.outer(sd, sd) / 2
            np.fill_diagonal(corr, 0)
            discount = 1 / (1 + np.clip(corr, 0, 1).sum(1))
    return rates, discount, prior


def _posterior(hit: np.ndarray, rates: np.ndarray, discount: np.ndarray, prior: float) -> np.ndarray:
    yes, no = np.log(rates[:, 0] / rates[:, 1]), np.log((1 - rates[:, 0]) / (1 - rates[:, 1]))
    odds = np.log(prior / (1 - prior)) + (hit * yes * discount + (1 - hit) * no * discount).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(rows: list[dict[int, float]], target: np.ndarray, width: int, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows with soft labels; both classes weigh the same."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], np.int64)
    value = np.array([v for r in rows for v in r.values()], np.float64)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= max(weight.sum(), 1e-9)
    w, b, speed, rate = np.zeros(width), 0.0, np.zeros(width + 1), 4.0
    for _ in range(steps):
        odds = b + np.bincount(owner, value * w[column], len(rows))
        err = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target)
        grad = np.r_[np.bincount(column, value * err[owner], width) + ridge * w, err.sum()]
        speed = 0.9 * speed - rate * grad
        w, b = w + speed[:-1], b + speed[-1]
    return w, float(b)


def _row(votes: int, hits: list[int], counts: list[int], features: int, voters: int) -> dict[int, float]:
    out = {f: float(min(n, 3)) / 3 for f, n in zip(hits, counts)}
    out.update({features + j: 1.0 for j in range(voters) if votes >> j & 1})
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, DataFrame]:
    """The model, and the stored :func:`hit_table` of all rows of ``docs``."""
    shards = induce_features(docs, labels, sample, id_col, text_col, label_col)
    model = Model({f: i for i, f in enumerate(shards)}, list(shards.values()))
    hits = materialise(hit_table(docs, model, id_col, text_col), "hits")
    learning = hits.where(~F.col("held_out") & F.col("id").isNotNull())
    patterns = {r["votes"]: r["n"] for r in learning.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 2**voters rows
    model.rates, model.discount, model.prior = fit_label_model(patterns or {0: 1}, model.voters)
    rows = hashed_sample(learning, "id", sample).select("votes", "hits", "counts").collect()  # at most ``sample`` rows
    width = len(model.features) + model.voters
    if rows:
        bits = np.array([[r["votes"] >> j & 1 for j in range(model.voters)] for r in rows], np.float64)
        posterior = _posterior(bits, model.rates, model.discount, model.prior)
        model.weights, model.bias = _logistic([_row(r["votes"], r["hits"], r["counts"], len(model.features), model.voters) for r in rows], posterior, width)
    else:
        model.weights = np.zeros(width)
    return model, hits


def scored(hits: DataFrame, model: Model) -> DataFrame:
    """``id, held_out, score`` from a :func:`hit_table`."""
    weights, bias, n, voters = model.weights, model.bias, len(model.features), model.voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.array([bias + sum(weights[c] * v for c, v in _row(*r, n, voters).items()) for r in zip(*(c.to_pylist() for c in batch.columns[2:]))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], ["id", "held_out", "score"])

    return hits.mapInArrow(run, hits.select("id").schema.simpleString()[7:-1].replace(":", " ") + ", held_out boolean, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = THRESHOLD) -> DataFrame:
    """Per row: ``id_col, held_out, score, predicted``."""
    model, hits = train(docs, labels, sample, id_col, text_col, label_col)
    return scored(hits, model).select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns."""
    bad = materialise(toxicity(docs, labels, sample, id_col, text_col, label_col, threshold).where("predicted = 1 and " + f"`{id_col}` is not null")
                      .select(F.col(id_col).alias("bad")).distinct(), "toxic")
    rows = docs.select(F.col(id_col).alias("id"), whole_row(docs).alias("row"))
    return rows.join(bad, rows["id"] == bad["bad"], "left_anti").select("row.*")
