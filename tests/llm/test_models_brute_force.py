"""The label model, the scorer, the conditional random field and the pipeline against plain definitions."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from docsift.llm import html_text, quality
from tests.conftest import SF001
from tests.llm.test_operators import LONG, ODD, table


def em(documents, rounds):
    """Expectation-maximisation document by document; votes are strings of g, b and -."""
    m = len(documents[0])
    good = [(d.count("g") + 1) / (d.count("g") + 3 * d.count("b") + 2) for d in documents]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(documents) + 2)
        table = [[{v: 0.1 for v in "gb-"} for _ in range(m)] for _ in (0, 1)]
        for d, p in zip(documents, good):
            for i, v in enumerate(d):
                table[0][i][v] += 1 - p
                table[1][i][v] += p
        for side in table:
            for i, counts in enumerate(side):
                total = sum(counts.values())
                side[i] = {v: c / total for v, c in counts.items()}
        new = []
        for d in documents:
            odds = math.log(1 - prior) - math.log(prior) + sum(math.log(table[0][i][v]) - math.log(table[1][i][v]) for i, v in enumerate(d))
            new.append(1 / (1 + math.exp(min(max(odds, -700), 700))))
        done = max(abs(a - b) for a, b in zip(good, new)) < 1e-9
        good = new
        if done:
            break
    return prior, dict(zip(documents, good))


def test_label_model_equals_em_over_documents():
    rng = random.Random(3)
    for trial in range(5):
        documents = []
        for _ in range(200):
            truth = rng.random() < 0.7
            documents.append("".join("-" if rng.random() < 0.2 else "gb"[(rng.random() < right) != truth] for right in (0.9, 0.8, 0.65, 0.55)))
        counts = {d: documents.count(d) for d in set(documents)}
        model = quality.LabelModel(counts, rounds=60)
        prior, posterior = em(documents, 60)
        assert abs(model.prior - prior) < 1e-6
        assert all(abs(model.posterior[d] - p) < 1e-6 for d, p in posterior.items())
    assert quality.LabelModel({}).posterior == {}


def test_accuracies_are_near_the_labellers_that_made_the_votes():
    rng, rates = random.Random(5), (0.95, 0.85, 0.75, 0.9, 0.8, 0.7, 0.6)
    counts: dict = {}
    for _ in range(20000):
        truth = rng.random() < 0.6
        d = "".join("gb"[(rng.random() < right) != truth] for right in rates)
        counts[d] = counts.get(d, 0) + 1
    found = list(quality.LabelModel(counts).accuracies().values())
    assert all(abs(a - b) < 0.03 for a, b in zip(found, rates))


def test_scorer_equals_the_dot_product_of_its_features():
    rng = np.random.default_rng(1)
    scorer = quality.Scorer(rng.standard_normal(1 << quality.BITS), 0.3)
    for text in ("one", "Two words!", "A a A b. " * 30, LONG, "$$ ## 12 x^2 { } " * 9, "ÉCOLE école 3e"):
        words = text.split()
        slots, values = quality.features(words, quality.statistics(words, text))
        margin = sum(scorer.weights[s] * v for s, v in zip(slots, values)) + scorer.bias
        assert abs(scorer(text) - 1 / (1 + math.exp(-margin))) < 1e-9
    assert scorer("") == 0.0 and scorer(None) == 0.0 and scorer(" \n") == 0.0


def test_fit_separates_what_can_be_separated():
    samples = [([1, 5], [1.0, 0.2]), ([2, 5], [1.0, 0.9]), ([1], [0.5]), ([2], [0.4])] * 10
    weights, bias = quality.fit(samples, np.array([1.0, 0.0, 0.9, 0.1] * 10))
    margins = [sum(weights[s] * v for s, v in zip(*x)) + bias for x in samples[:4]]
    assert margins[0] > 0 > margins[1] and margins[2] > 0 > margins[3]


def chains(rng, n):
    field = html_text.Field()
    names = [f"f{i}" for i in range(6)]
    field.weights = {x: rng.gauss(0, 2) for x in names}
    field.step = [[rng.gauss(0, 1) for _ in (0, 1)] for _ in (0, 1)]
    field.start = [rng.gauss(0, 1) for _ in (0, 1)]
    return field, [tuple(rng.sample(names, rng.randint(1, 3))) for _ in range(n)]


def test_viterbi_and_marginals_equal_enumeration():
    rng = random.Random(9)
    for _ in range(60):
        field, feats = chains(rng, rng.randint(1, 7))

        def total(labels):
            out = field.start[labels[0]] + sum(field.score(f) for f, y in zip(feats, labels) if y)
            return out + sum(field.step[a][b] for a, b in zip(labels, labels[1:]))
        every = {y: total(y) for y in itertools.product((0, 1), repeat=len(feats))}
        assert abs(total(tuple(field.decode(feats))) - max(every.values())) < 1e-9
        z = sum(map(math.exp, every.values()))
        node, pair = field.marginals(feats)
        for k in range(len(feats)):
            assert abs(node[k] - sum(math.exp(s) for y, s in every.items() if y[k]) / z) < 1e-9
        for k, i, j in itertools.product(range(len(feats) - 1), (0, 1), (0, 1)):
            assert abs(pair[k][i][j] - sum(math.exp(s) for y, s in every.items() if (y[k], y[k + 1]) == (i, j)) / z) < 1e-9
    assert html_text.Field().decode([]) == []


def test_whole_articles_of_the_given_pages():
    """The text of every given page is exactly what stands between its article tags (white space apart)."""
    import re
    from html import unescape

    import pyarrow.parquet as pq
    field, wrong, seen = html_text.trained(), [], 0
    for page in pq.read_table(f"{SF001}/pages.parquet")["html"].to_pylist():
        article = re.search(r"<article[^>]*>(.*?)(</article>|$)", page, re.S)
        if article:
            seen += 1
            want = "".join(unescape(re.sub(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", "", article[1], flags=re.S)).split())
            if "".join(html_text.main_text(page, field).split()) != want:
                wrong.append(page)
    assert seen and not wrong, (len(wrong), seen)


def test_pipeline_stages_against_brute_force(spark):
    """Line dedup, near dedup and mixing of the pipeline on odd rows, each by its definition."""
    import corpus_pipeline as P
    texts = ODD + [(100 + i, f"own line {i}\nshared line\nend {i}") for i in range(12)]
    docs = table(spark, texts)
    want = sorted(((i is None, i or 0, None if t is None else "\n".join(x for x in t.split("\n") if x.strip().lower() != "shared line")) for i, t in texts), key=str)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in P.line_stage(spark, docs, SF001).collect()), key=str)
    assert got == want
    mixed = P.mixing_stage(spark, docs, SF001)
    per = {(r.doc_id, r.text): r["n"] for r in mixed.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(per) <= set(texts) and max(per.values()) <= 2 * max(texts.count(t) for t in texts)
