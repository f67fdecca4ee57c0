"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Documents are counted by vote
pattern (at most 3^labellers patterns), and expectation-maximisation over these counts, which cover all documents,
estimates the class prior and every labeller's accuracies.  The posterior of a document's pattern is its weak label.
A hashed linear scorer (logistic) is trained on the posteriors of a bounded sample, ``SAMPLE_DOCS`` distinct texts a
class with the least md5(doc_id), and scores all whole texts.

Scorer features: relative frequency of each word and of each word shape, hashed, and binned document ratios.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sliced, stored

SAMPLE_DOCS = 1000
CONFIDENT = 0.9
BITS = 18
ROUNDS = 200
MEMO = 100_000
#: Signs that prose holds rarely.
SIGNS = "!$%&*#|^~<>{}[]=+@_\\"

STATS = ("n_words", "sign_share", "upper_share", "distinct_share", "top_share", "bare_share", "word_length", "stop_share")


def statistics(words: list[str], text: str) -> tuple:
    """Ratios of a text, in the order of STATS."""
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    counts = Counter(words)
    return (n, sum(map(text.count, SIGNS)) / len(text), sum(map(str.isupper, words)) / n, len(counts) / n,
            max(counts.values()) / n, sum(not any(map(str.isalnum, w)) * c for w, c in counts.items()) / n,
            sum(map(len, words)) / n, sum(w[-1] in ".,;:!?" for w in words) / n)


def _between(value, bad_low, good_low, good_high, bad_high) -> str:
    if value < bad_low or value > bad_high:
        return "b"
    return "g" if good_low <= value <= good_high else "-"


#: Labeller name -> vote on the statistics: g(ood), b(ad) or - for none.
LABELLERS = {
    "signs": lambda s: _between(s[1], -1, 0, 0.01, 0.06),
    "capitals": lambda s: _between(s[2], -1, 0, 0.1, 0.4),
    "variety": lambda s: "-" if s[0] < 20 else _between(s[3], 0.25, 0.45, 1, 2),
    "top word": lambda s: "-" if s[0] < 20 else _between(s[4], -1, 0, 0.2, 0.4),
    "bare signs": lambda s: _between(s[5], -1, 0, 0.02, 0.15),
    "word length": lambda s: _between(s[6], 2.5, 3.5, 8, 12),
    "punctuation": lambda s: "-" if s[0] < 30 else _between(s[7], 0.01, 0.03, 0.5, 0.7),
}


def votes(stats: tuple) -> str:
    """One character a labeller; texts without words get no votes at all."""
    return "".join(f(stats) for f in LABELLERS.values()) if stats[0] else "-" * len(LABELLERS)


class LabelModel:
    """Class prior and P(vote | class) of every labeller, by expectation-maximisation over pattern counts."""

    def __init__(self, counts: dict[str, int], rounds: int = ROUNDS):
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], float)
        m = len(patterns[0]) if patterns else 0
        given = np.array([[[v == x for x in "gb-"] for v in p] for p in patterns], float).reshape(len(patterns), m, 3)
        good = np.array([(p.count("g") + 1) / (p.count("g") + 3 * p.count("b") + 2) for p in patterns])
        self.prior, self.table = 0.5, np.full((2, m, 3), 1 / 3)
        for _ in range(rounds if patterns else 0):
            weight = np.stack([n * (1 - good), n * good])
            self.prior = (weight[1].sum() + 1) / (n.sum() + 2)
            table = np.einsum("cp,pmv->cmv", weight, given) + 0.1
            self.table = table / table.sum(axis=2, keepdims=True)
            new = np.array([self._posterior(g) for g in given])
            done = np.abs(new - good).max() < 1e-9
            good = new
            if done:
                break
        self.posterior = dict(zip(patterns, good.tolist()))

    def _posterior(self, given) -> float:
        log = (np.log(self.table) * given).sum(axis=(1, 2)) + np.log([1 - self.prior, self.prior])
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))

    def accuracies(self) -> dict[str, float]:
        """P(a labeller's vote is right, given that it votes)."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.table[0, :, 1] + share[1] * self.table[1, :, 0]
        any_vote = (share[:, None] * self.table[:, :, :2].sum(axis=2)).sum(axis=0)
        return dict(zip(LABELLERS, (right / any_vote).tolist()))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Word shape: letters as A or a, digits as 0, runs once."""
    return _RUNS.sub(r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


#: Bin edges of the document ratios, and those that a text of few words cannot show.
EDGES = {"sign_share": (0.01, 0.06), "upper_share": (0.1, 0.4), "distinct_share": (0.25, 0.45), "top_share": (0.2, 0.4),
         "bare_share": (0.02, 0.15), "word_length": (2.5, 3.5, 8, 12), "stop_share": (0.01, 0.03, 0.5, 0.7)}
LONG_ONLY = {"distinct_share": 20, "top_share": 20, "word_length": 5, "stop_share": 30}


def ratio_slots(stats: tuple) -> list[int]:
    """Slots of the binned document ratios."""
    return [_slot(f"r:{name}:{sum(v > e for e in EDGES[name])}") for name, v in zip(STATS[1:], stats[1:])
            if stats[0] >= LONG_ONLY.get(name, 0)]


def features(words: list[str], stats: tuple) -> tuple[list[int], list[float]]:
    """Slots and values of a text's features; a slot may repeat."""
    slots = ratio_slots(stats)
    values = [1.0] * len(slots)
    for w, c in Counter(words).items():
        slots += [_slot("w:" + w.lower()), _slot("s:" + shape(w))]
        values += [c / len(words)] * 2
    return slots, values


def fit(samples: list[tuple[list[int], list[float]]], targets: np.ndarray, rounds: int = 150, rate: float = 0.5,
        l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by Adagrad on the whole sample; both classes weigh the same."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not samples:
        return weights, bias
    rows = np.repeat(np.arange(len(samples)), [len(s) for s, _ in samples])
    slots = np.concatenate([np.asarray(s, np.int32) for s, _ in samples])
    values = np.concatenate([np.asarray(v, np.float32) for _, v in samples])
    share = targets.mean()
    importance = np.where(targets > 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(samples)
    seen, seen_bias = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        margin = np.bincount(rows, weights[slots] * values, len(samples)) + bias
        slope = (1 / (1 + np.exp(-margin)) - targets) * importance
        grad = np.bincount(slots, slope[rows] * values, 1 << BITS) + l2 * weights
        seen += grad ** 2
        weights -= rate * grad / np.sqrt(seen)
        seen_bias += slope.sum() ** 2
        bias -= rate * slope.sum() / np.sqrt(seen_bias)
    return weights, bias


class Scorer:
    """P(good) of texts; words' summed weights are remembered within a task."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.memo = weights, bias, {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def __call__(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        if len(self.memo) > MEMO:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = float(self.weights[_slot("w:" + w.lower())] + self.weights[_slot("s:" + shape(w))])
        margin = sum(map(self.memo.__getitem__, words)) / len(words) + self.bias
        margin += float(self.weights[ratio_slots(statistics(words, text))].sum())
        return float(1 / (1 + np.exp(np.clip(-margin, -700, 700))))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[LabelModel, Scorer]:
    """Label model over all documents and the scorer of its posteriors."""
    def vote(batches):
        for batch in sliced(batches):
            got = [votes(statistics(t.split(), t)) if t else "-" * len(LABELLERS) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string()), batch.column(2)],
                                             names=["doc_id", "votes", "digest"])

    voted = stored(docs.select("doc_id", "text", F.md5("text").alias("digest"))
                   .mapInArrow(vote, "doc_id long, votes string, digest string"), "quality-votes")
    counts = {r["votes"]: r["n"] for r in  # bounded: 3^labellers patterns
              voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    model = LabelModel({p: n for p, n in counts.items() if p.strip("-")})

    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = {}
    for good in (True, False):
        patterns = [p for p, x in model.posterior.items() if (x >= CONFIDENT if good else x <= 1 - CONFIDENT)]
        texts = voted.where(F.col("votes").isin(patterns)).groupBy("digest", "votes").agg(F.min(key).alias("key"))
        for r in texts.orderBy("key", "votes", "digest").limit(sample_docs).toLocalIterator():  # bounded
            chosen[r["digest"]] = model.posterior[r["votes"]]
    spark = docs.sparkSession
    digests = spark.createDataFrame([(d,) for d in chosen], "digest string")
    sample = (docs.select(F.md5("text").alias("digest"), "text").join(F.broadcast(digests), "digest", "left_semi")
              .groupBy("digest").agg(F.first("text").alias("text")))  # bounded: 2 * sample_docs texts

    def extract(batches):
        for batch in sliced(batches):
            got = [features((t or "").split(), statistics((t or "").split(), t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(s, "<i4").tobytes() for s, _ in got], pa.binary()),
                                              pa.array([np.array(v, "<f4").tobytes() for _, v in got], pa.binary())],
                                             names=["digest", "slots", "values"])

    rows = sorted((r["digest"], bytes(r["slots"]), bytes(r["values"])) for r in sample.mapInArrow(
        extract, "digest string, slots binary, values binary").toLocalIterator())  # bounded: the sample
    targets = np.array([chosen[i] for i, _, _ in rows])
    if not len(rows) or targets.min() > 0.5 or targets.max() < 0.5:  # nothing to tell apart
        return model, Scorer(np.zeros(1 << BITS), 1.0 if not len(rows) or targets.min() > 0.5 else -1.0)
    return model, Scorer(*fit([(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4")) for _, s, v in rows], targets))


def score(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """(doc_id, score, accepted) of every row of ``docs`` (doc_id, text).

    Null texts and texts without words score 0 and are rejected.  If the weak labels hold one class only, every text
    with words gets the same score.  Repeated rows each get a result; an empty table gives none; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in sliced(batches):
            got = [shared.value(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array([x >= least for x in got])],
                                             names=["doc_id", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, accepted boolean")


def accepted(docs: DataFrame, scorer: Scorer, least: float = 0.5) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array([shared.value(t) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
