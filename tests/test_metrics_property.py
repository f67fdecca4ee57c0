"""Property test: evaluate_run equals a direct Python implementation of the metric definitions."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docsift.operators import evaluate as E

K_VALUES = (1, 2, 3, 5)


def python_metrics(run, qrels, k_values):
    rel = {}
    judged = set()
    for q, d, r in qrels:
        judged.add(d)
        if r > 0:
            rel.setdefault(q, set()).add(d)
    ranked = {}
    for q, d, rank in run:
        ranked.setdefault(q, []).append((rank, d))
    out = {}
    evaluated = [q for q in ranked if q in rel]
    for k in k_values:
        vals = {m: [] for m in E.METRICS}
        for q in evaluated:
            docs = [d for _, d in sorted(ranked[q])][:k]
            R = rel[q]
            flags = [1 if d in R else 0 for d in docs]
            hits = sum(flags)
            dcg = sum(f / math.log2(i + 2) for i, f in enumerate(flags))
            idcg = sum(1 / math.log2(i + 2) for i in range(min(k, len(R))))
            ap = sum(f * sum(flags[: i + 1]) / (i + 1) for i, f in enumerate(flags)) / len(R)
            first = next((i + 1 for i, f in enumerate(flags) if f), None)
            vals["ndcg"].append(dcg / idcg)
            vals["map"].append(ap)
            vals["recall"].append(hits / len(R))
            vals["precision"].append(hits / k)
            vals["mrr"].append(1 / first if first else 0.0)
            vals["recall_cap"].append(hits / min(k, len(R)))
            vals["hole"].append(sum(1 for d in docs if d not in judged) / k)
        if evaluated:
            out[k] = {m: sum(v) / len(v) for m, v in vals.items()}
    return out


@st.composite
def run_and_qrels(draw):
    n_q = draw(st.integers(1, 4))
    run, qrels = [], []
    for q in range(n_q):
        docs = draw(st.lists(st.integers(0, 12), min_size=0, max_size=6, unique=True))
        run += [(q, d, i + 1) for i, d in enumerate(docs)]
        judged = draw(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), max_size=5, unique_by=lambda t: t[0]))
        qrels += [(q, d, r) for d, r in judged]
    return run, qrels


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])
@given(data=run_and_qrels())
def test_evaluate_matches_definitions(spark, data):
    run, qrels = data
    run_df = spark.createDataFrame([(q, d, float(-r), r) for q, d, r in run],
                                   "query_id long, doc_id long, score double, rank int")
    qrels_df = spark.createDataFrame([(q, d, None, r) for q, d, r in qrels],
                                     "query_id long, doc_id long, language string, relevance int")
    got = {r["k"]: r for r in E.evaluate_run(run_df, qrels_df, K_VALUES).collect()}
    exp = python_metrics(run, qrels, K_VALUES)
    assert set(got) == set(exp)
    for k, m in exp.items():
        for name, v in m.items():
            assert abs(got[k][name] - round(v, 5)) <= 1e-5, (k, name, got[k][name], v)
