import math

import pytest

from docsift.operators import evaluate as E
from docsift.operators.lexical import rank_top_k


def _run(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def _qrels(spark, rows):
    return spark.createDataFrame([(q, d, None, r) for q, d, r in rows],
                                 "query_id long, doc_id long, language string, relevance int")


def _report(df):
    return {r["k"]: r for r in df.collect()}


def test_perfect_run(spark):
    run = _run(spark, [(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)])
    qrels = _qrels(spark, [(1, 10, 1), (1, 11, 1)])
    rep = _report(E.evaluate_run(run, qrels, (1, 2, 3)))
    assert rep[2]["ndcg"] == 1.0 and rep[2]["map"] == 1.0 and rep[2]["recall"] == 1.0 and rep[2]["precision"] == 1.0
    assert rep[1]["recall"] == 0.5 and rep[1]["recall_cap"] == 1.0 and rep[1]["mrr"] == 1.0
    # doc 12 is unjudged -> hole@3 = 1/3
    assert rep[3]["hole"] == round(1 / 3, 5)


def test_reversed_run_hand_computed(spark):
    # relevant docs at ranks 2 and 3 of 3
    run = _run(spark, [(1, 12, 3.0, 1), (1, 11, 2.0, 2), (1, 10, 1.0, 3)])
    qrels = _qrels(spark, [(1, 10, 1), (1, 11, 1), (1, 12, 0)])
    rep = _report(E.evaluate_run(run, qrels, (3,)))[3]
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    idcg = 1 + 1 / math.log2(3)
    assert rep["ndcg"] == round(dcg / idcg, 5)
    assert rep["map"] == round((1 / 2 + 2 / 3) / 2, 5)
    assert rep["mrr"] == 0.5
    assert rep["precision"] == round(2 / 3, 5)
    assert rep["hole"] == 0.0          # all three docs are judged (relevance 0 counts as judged)


def test_more_relevant_than_k(spark):
    run = _run(spark, [(1, 10, 2.0, 1), (1, 99, 1.0, 2)])
    qrels = _qrels(spark, [(1, d, 1) for d in (10, 11, 12, 13)])
    rep = _report(E.evaluate_run(run, qrels, (2,)))[2]
    assert rep["recall"] == 0.25 and rep["recall_cap"] == 0.5 and rep["precision"] == 0.5
    assert rep["recall_cap"] >= rep["recall"]


def test_query_without_hits_and_denominators(spark):
    run = _run(spark, [(1, 10, 1.0, 1), (2, 50, 1.0, 1)])
    qrels = _qrels(spark, [(1, 10, 1), (2, 20, 1), (3, 30, 1)])
    retrieved = _report(E.evaluate_run(run, qrels, (1,)))[1]
    judged = _report(E.evaluate_run(run, qrels, (1,), denominator="judged"))[1]
    assert retrieved["n_queries"] == 2 and retrieved["recall"] == 0.5
    assert judged["n_queries"] == 3 and judged["recall"] == round(1 / 3, 5)


def test_empty_run(spark):
    run = _run(spark, [])
    qrels = _qrels(spark, [(1, 10, 1)])
    assert E.evaluate_run(run, qrels, (1,)).count() == 0


def test_tie_break_by_doc_id(spark):
    scored = spark.createDataFrame([(1, 7, 1.0000001), (1, 3, 1.0000004), (1, 5, 0.5)],
                                   "query_id long, doc_id long, score double")
    out = [(r["doc_id"], r["rank"]) for r in rank_top_k(scored, 2).orderBy("rank").collect()]
    # both round to 1.0 at 6 decimals -> doc 3 before doc 7
    assert out == [(3, 1), (7, 2)]


@pytest.mark.parametrize("k_values", [(1, 3, 5, 10, 100)])
def test_metric_properties_on_fixture(spark, k_values):
    from docsift.plans.catalog import fx1, fx1_bm25_run
    from tests.conftest import SF01

    d = fx1(spark, SF01)
    pq = E.per_query_metrics(fx1_bm25_run(spark, SF01), d.qrels, k_values).collect()
    by_q = {}
    for r in pq:
        for m in ("ndcg", "map", "recall", "precision", "mrr", "recall_cap", "hole"):
            assert -1e-12 <= r[m] <= 1 + 1e-12
        assert r["recall_cap"] >= r["recall"] - 1e-12
        by_q.setdefault(r["query_id"], {})[r["k"]] = r["recall"]
    for ks in by_q.values():
        vals = [ks[k] for k in sorted(ks)]
        assert vals == sorted(vals)          # recall non-decreasing in k


def test_golden_values_sf001(spark):
    """SURVEY golden table (BM25 top-100 over FX-1 at sf0.01)."""
    from docsift.plans.catalog import QUERIES
    from tests.conftest import SF01

    rep = {r["k"]: r for r in QUERIES["evaluate_run"](spark, SF01).collect()}
    assert rep[1]["n_queries"] == 20
    assert (rep[3]["ndcg"], rep[3]["map"], rep[3]["precision"], rep[3]["hole"]) == (0.98066, 0.975, 0.41667, 0.58333)
    assert (rep[10]["ndcg"], rep[10]["map"], rep[10]["recall"]) == (0.99088, 0.98214, 1.0)
    assert rep[100]["hole"] == 0.963


def test_exclude_self_reranks(spark):
    # doc 1 is the query itself at rank 1; without it doc 10 (relevant) moves to rank 1
    run = _run(spark, [(1, 1, 9.0, 1), (1, 10, 5.0, 2), (1, 11, 1.0, 3)])
    qrels = _qrels(spark, [(1, 10, 1)])
    kept = _report(E.evaluate_run(run, qrels, (1,)))[1]
    dropped = _report(E.evaluate_run(run, qrels, (1,), exclude_self=True))[1]
    assert kept["precision"] == 0.0 and dropped["precision"] == 1.0 and dropped["mrr"] == 1.0


def test_warn_on_empty_overlap(spark):
    import pytest as _pt

    run = _run(spark, [(1, 10, 1.0, 1)])
    qrels = _qrels(spark, [(2, 10, 1)])
    with _pt.warns(RuntimeWarning):
        assert E.evaluate_run(run, qrels, (1,), warn_empty=True).count() == 0
