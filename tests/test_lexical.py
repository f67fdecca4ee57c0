"""BM25 against a brute-force Python implementation, block sizes and the physical plan."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsift.operators import lexical as L

DOCS = [
    (1, "the court ruled on the appeal of the tenant"),
    (2, "the tenant paid the rent and the court dismissed"),
    (3, "appeal appeal appeal against the ruling"),
    (4, "the the the the the"),
    (5, "rent increase for the tenant of the flat"),
    (6, "a ruling about a flat and a garden"),
    (7, ""),
    (8, "Garden rules: the tenant shall keep the garden"),
]
QUERIES = [(100, "tenant appeal"), (101, "the garden"), (102, "the"), (103, "unknownword"), (104, "court rent ruling the")]


def tokens(t):
    return [x for x in re.sub(r"[^\w]+|_", lambda m: " " if m.group(0) != "_" else "_", t.lower()).split() if x]


def brute(docs, queries, k=3, k1=1.2, b=0.75):
    toks = {d: tokens(t) for d, t in docs}
    toks = {d: t for d, t in toks.items() if t}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    df = Counter(term for t in toks.values() for term in set(t))
    out = {}
    for q, text in queries:
        scores = {}
        for term, qtf in Counter(tokens(text)).items():
            if term not in df:
                continue
            idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
            for d, t in toks.items():
                tf = t.count(term)
                if tf:
                    scores[d] = scores.get(d, 0.0) + qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avgdl))
        ranked = sorted(((round(s, 6), d) for d, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        out[q] = [(d, s) for s, d in ranked]
    return out


@pytest.fixture(scope="module")
def data(spark):
    corpus = spark.createDataFrame([(d, "", t, "en") for d, t in DOCS], "doc_id long, title string, text string, language string")
    queries = spark.createDataFrame([(q, t, "en") for q, t in QUERIES], "query_id long, text string, language string")
    return corpus, queries


def as_dict(run):
    out = {}
    for r in run.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_matches_brute_force(spark, data):
    corpus, queries = data
    idx = L.bm25_index(corpus)
    got = as_dict(L.bm25_search(idx, queries, top_k=3))
    exp = {q: v for q, v in brute(DOCS, QUERIES).items() if v}
    assert got.keys() == exp.keys()
    for q in exp:
        assert [d for d, _ in got[q]] == [d for d, _ in exp[q]]
        for (_, a), (_, b) in zip(got[q], exp[q]):
            assert abs(a - b) < 2e-6


@pytest.mark.parametrize("block_bytes", [1, 400])
def test_block_size_does_not_change_results(spark, data, block_bytes):
    corpus, queries = data
    idx = L.bm25_index(corpus)
    for k in (1, 5):
        assert as_dict(L.bm25_search(idx, queries, top_k=k, block_bytes=block_bytes)) == \
            as_dict(L.bm25_search(idx, queries, top_k=k))


def test_pairs_are_not_exchanged(spark, data):
    """Queries are scored where the postings lie: the only wide exchange is by query, of what the tasks kept."""
    corpus, queries = data
    idx = L.bm25_index(corpus)
    terms = L.query_terms(queries, idx).select("query_id", "term", "w").persist()
    terms.count()
    plan = L.rank_top_k(L.block_hits(idx, terms, 3), 3)._jdf.queryExecution().executedPlan().toString()
    head = plan.split("InMemoryTableScan")[0]
    assert head.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(query_id" in head, plan
    assert head.index("WindowGroupLimit") < head.index("Exchange hashpartitioning") < head.index("MapInArrow"), plan
    assert "Sort [doc_id" not in head and "HashAggregate" not in head, plan  # the index's own order serves


@pytest.mark.parametrize("segment", [1, 7, 10 ** 6])
def test_search_equals_brute_force_with_ties(spark, segment):
    """Random corpora with many equal documents: segment cuts lose nothing."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(150)]
    docs += [(1000 + i, "w1 w2 w2") for i in range(40)]
    queries = [(i, " ".join(rng.choices(words, k=4))) for i in range(12)] + [(50, "w1 w2"), (51, "w2 w2 w29")]
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    idx = L.bm25_index(corpus)
    terms = L.query_terms(spark.createDataFrame(queries, "query_id long, text string"), idx).select("query_id", "term", "w")
    run = L.rank_top_k(L.block_hits(idx, terms, 5, segment_postings=segment), 5)
    got = {}
    for r in run.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 5)))
    want = {q: [(d, round(s, 5)) for d, s in v] for q, v in brute(docs, queries, 5).items() if v}
    assert {q: [d for d, _ in v] for q, v in got.items()} == {q: [d for d, _ in v] for q, v in want.items()}


def test_kernel_equals_a_full_scan():
    import numpy as np

    from docsift.functions.postings import Best, PostingBlocks
    rng = np.random.default_rng(3)
    for size in (1, 3, 64):
        docs = np.repeat(np.arange(300), 5)
        terms = np.concatenate([rng.choice(40, 5, replace=False) for _ in range(300)])
        impacts = rng.integers(1, 4, len(docs)) / 2  # many ties
        blocks = PostingBlocks(np.arange(300) * 2, docs, terms, impacts, 40, size)
        for _ in range(20):
            query = rng.choice(40, 6, replace=False)
            weights = rng.integers(1, 3, 6).astype(float)
            amount = np.zeros(40)
            amount[query] = weights
            exact = np.bincount(docs, amount[terms] * impacts, 300)
            want = sorted((-x, 2 * i) for i, x in enumerate(exact.tolist()) if x > 0)[:10]
            best = Best(10)
            blocks.search(query, weights, best)
            assert list(zip((-best.scores[:10]).tolist(), best.ids[:10].tolist())) == want


def test_kernel_skips_blocks_that_cannot_reach_the_kth_score():
    import numpy as np

    from docsift.functions.postings import Best, PostingBlocks
    rng = np.random.default_rng(1)
    n = 6400
    impacts = np.sort(rng.random(n))[::-1] + 0.01  # falling over the documents, so early blocks hold the best
    blocks = PostingBlocks(np.arange(n), np.arange(n), np.zeros(n, np.int64), impacts, 1)
    best = Best(10)
    blocks.search(np.array([0]), np.array([2.0]), best)
    assert best.ids[:10].tolist() == list(range(10)) and blocks.scored < n / 10
    ids = PostingBlocks(np.array(["b", "a", "c"], object), np.arange(3), np.zeros(3, np.int64), np.ones(3), 1)
    few = Best(2)
    ids.search(np.array([0]), np.array([1.0]), few, skip="c")
    assert few.ids.tolist() == ["a", "b"]


def test_golden_sums_of_the_fixture(spark):
    from docsift.plans.catalog import fx1
    from tests.conftest import SF01

    d = fx1(spark, SF01)
    idx = L.bm25_index(d.corpus)
    a = L.bm25_search(idx, d.queries).agg(F.count("*"), F.sum("score"), F.sum("doc_id")).first()
    # the golden sums of SURVEY section 5
    assert a[0] == 4000 and round(a[1], 6) == 135960.259014 and a[2] == 1993558


def test_exclude_self_and_multisearch(spark, data):
    corpus, _ = data
    idx = L.bm25_index(corpus)
    docs = corpus.select("doc_id", F.col("text").alias("full_text"))
    hits = L.bm25_multisearch_docs(idx, docs, top_hits=2)
    top1 = {r["query_id"]: r["doc_id"] for r in hits.where("rank = 1").collect()}
    assert top1[3] == 3      # a document retrieves itself first
    no_self = L.bm25_search(idx, docs.withColumnRenamed("doc_id", "query_id").withColumnRenamed("full_text", "text"),
                            top_k=2, exclude_self=True)
    assert no_self.where("query_id = doc_id").count() == 0


def test_products_equal_a_full_scan():
    """Frequent and rare terms, short and long queries, a skipped id: products over segments give the exact top k."""
    import numpy as np

    from docsift.functions.postings import Best, PostingProducts
    rng = np.random.default_rng(4)
    docs = np.concatenate([np.full(n, i) for i, n in enumerate(rng.integers(1, 30, 300))])
    terms = np.concatenate([rng.choice(40, n, replace=False) for n in np.bincount(docs)])
    impacts = rng.integers(1, 4, len(docs)) / 2  # many ties
    queries = [rng.choice(40, n, replace=False) for n in (1, 5, 40, 12, 30, 2, 7, 9, 33)]
    runs = np.append(0, np.cumsum([len(q) for q in queries]))
    weights = rng.integers(1, 3, runs[-1]).astype(float)
    for share in (1, 3, 10 ** 6):
        best = [Best(10) for _ in queries]
        for low, high in ((0, 130), (130, 131), (131, 300)):
            here = (docs >= low) & (docs < high)
            PostingProducts(np.arange(low, high) * 2, docs[here] - low, terms[here], impacts[here], 40, share).search(
                runs, np.concatenate(queries), weights, best, [2 * i for i in range(len(queries))])
        for i, q in enumerate(queries):
            amount = np.zeros(40)
            amount[q] = weights[runs[i]:runs[i + 1]]
            exact = np.bincount(docs, amount[terms] * impacts, 300)
            want = sorted((-x, 2 * d) for d, x in enumerate(exact.tolist()) if x > 0 and d != i)[:10]
            assert list(zip((-best[i].scores[:10]).tolist(), best[i].ids[:10].tolist())) == want


@pytest.mark.parametrize("skip", [False, True])
def test_floors_from_some_parts_lose_no_document(spark, skip):
    """Searching a part of the index first gives the same run, and the tasks then hand on fewer rows."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([2, 8, 40])))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(30)]  # equal documents
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    idx = L.bm25_index(corpus)
    terms = L.query_terms(corpus.limit(40).withColumnRenamed("doc_id", "query_id"), idx).select("query_id", "term", "w").persist()
    runs = []
    for parts in (0, 2):
        hits = L.block_hits(idx, terms, 5, exclude_self=skip, seed_parts=parts).persist()
        runs.append((hits.count(), sorted(map(tuple, L.rank_top_k(hits, 5).collect()))))
    assert runs[0][1] == runs[1][1] and len(runs[0][1]) == 200
    assert runs[1][0] < runs[0][0]


def test_products_in_single_precision_keep_close_scores_apart():
    """Scores that single precision cannot tell apart are still ranked exactly."""
    import numpy as np

    from docsift.functions.postings import Best, PostingProducts
    n = 600
    impacts = 1 + np.random.default_rng(2).permutation(n) * 1e-9
    products = PostingProducts(np.arange(n), np.arange(n), np.zeros(n, np.int64), impacts, 1)
    best = [Best(10), Best(10, 0.5)]
    products.search(np.array([0, 1, 2]), np.array([0, 0]), np.array([1.0, 1.0]), best)
    for b in best:
        assert b.ids[:10].tolist() == np.argsort(-impacts, kind="stable")[:10].tolist()


def test_block_of_queries_comes_as_one_row_a_query(spark, data):
    corpus, queries = data
    block = L.query_terms(queries, L.bm25_index(corpus)).select("query_id", "term", "w")
    ids, numbers, runs, terms, weights = L.block_queries(block)
    names = {r["tid"]: r["term"] for r in numbers.collect()}
    got = {(q, names[int(t)], w) for i, q in enumerate(ids) for t, w in zip(terms[runs[i]:runs[i + 1]], weights[runs[i]:runs[i + 1]])}
    assert got == {tuple(r) for r in block.collect()} and len(ids) == len(set(ids)) == 4
    assert all(len(x) == 0 for x in L.block_queries(block.where("false"))[3:])
