import math

from docsift.operators import lexical as L
from docsift.operators import rerank as R


def _setup(spark):
    corpus = spark.createDataFrame([(1, "", "alpha beta gamma", "en"), (2, "", "beta alpha delta", "en"),
                                    (3, "", "gamma gamma", "en"), (4, "", "epsilon zeta", "en")],
                                   "doc_id long, title string, text string, language string")
    queries = spark.createDataFrame([(10, "alpha beta", "en")], "query_id long, text string, language string")
    run = spark.createDataFrame([(10, 1, 1.0, 2), (10, 2, 2.0, 1), (10, 3, 0.5, 3)],
                                "query_id long, doc_id long, score double, rank int")
    return corpus, queries, run


def test_default_scorer_hand_computed(spark):
    corpus, queries, run = _setup(spark)
    idx = L.bm25_index(corpus)
    out = {r["doc_id"]: (r["score"], r["rank"]) for r in R.rerank_pairs(run, queries, corpus, index=idx).collect()}
    # docs 1 and 2 contain both query terms (coverage 1); only doc 1 has the bigram "alpha beta"
    assert out[1] == (round(1.0 * (1 + math.log(2)), 6), 1)
    assert out[2] == (1.0, 2)
    assert out[3] == (0.0, 3)


def test_pluggable_pandas_scorer(spark):
    corpus, queries, run = _setup(spark)
    out = {r["doc_id"]: r["rank"] for r in R.rerank_pairs(run, queries, corpus, scorer=R.text_overlap_scorer()).collect()}
    # Jaccard: doc1 2/3, doc2 2/4, doc3 0
    assert out == {1: 1, 2: 2, 3: 3}


def test_rerank_depth_cuts_candidates(spark):
    corpus, queries, run = _setup(spark)
    idx = L.bm25_index(corpus)
    out = R.rerank_pairs(run, queries, corpus, index=idx, depth=2)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_pooled_dense_rerank_brute_force(spark):
    from docsift.operators import dense as D

    corpus, queries, _ = _setup(spark)
    # two queries with disjoint candidate lists: pooled lets each see the other's candidates
    run = spark.createDataFrame([(10, 1, 1.0, 1), (11, 4, 1.0, 1)], "query_id long, doc_id long, score double, rank int")
    queries = spark.createDataFrame([(10, "alpha beta", "en"), (11, "epsilon alpha", "en")], "query_id long, text string, language string")
    qv, dv = D.encode_two_tower(queries, corpus, 16)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in
           R.rerank_dense(run, qv, dv, depth=1, k=2, candidate_scope="pooled", dim=16).collect()}
    q = {(r["id"], r["dim"]): r["w"] for r in qv.collect()}
    d = {(r["id"], r["dim"]): r["w"] for r in dv.collect()}
    for qid in (10, 11):
        exp = sorted(((round(sum(w * d.get((doc, dm), 0.0) for (i, dm), w in q.items() if i == qid), 6), doc)
                      for doc in (1, 4)), key=lambda t: (-t[0], t[1]))
        assert [got[(qid, doc)] for _, doc in exp] == [s for s, _ in exp]
