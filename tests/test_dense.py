"""Exact dense search vs numpy brute force; approximate operators measured against it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import dense as D
from docsift.operators import quantise as Q
from tests.conftest import SF01


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((300, 16)).astype(np.float32)
    m[5] = m[6]                                       # exact tie between two docs
    df = spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in enumerate(m)],
                               "id long, embedding array<float>")
    return df, m.astype(np.float64)


def brute(m, k, exclude_self=True, cos=False):
    x = m / np.linalg.norm(m, axis=1, keepdims=True) if cos else m
    s = x @ x.T
    out = {}
    for q in range(len(m)):
        cand = [(round(s[q, d], 6), d) for d in range(len(m)) if not (exclude_self and d == q)]
        cand.sort(key=lambda t: (-t[0], t[1]))
        out[q] = [d for _, d in cand[:k]]
    return out


def as_lists(run):
    out = {}
    for r in run.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["doc_id"])
    return out


@pytest.mark.parametrize("metric", ["dot", "cos"])
def test_exact_search(spark, vecs, metric):
    df, m = vecs
    got = as_lists(D.dense_search(df, df, 5, metric, exclude_self=True))
    assert got == brute(m, 5, True, metric == "cos")


def test_query_blocks_do_not_change_results(spark, vecs):
    df, m = vecs
    got = as_lists(D.dense_search(df, df, 7, "dot", exclude_self=False, block_cells=40 * 16))
    assert got == brute(m, 7, exclude_self=False)
    assert len(D.query_blocks(df, 16, 40 * 16)) == 8
    assert D.dense_search(df.limit(0), df, 5).count() == 0 and D.dense_search(df, df.limit(0), 5).count() == 0


def test_excluded_pairs_leave_the_search(spark, vecs):
    """Lists of very different length, one of nearly all documents: each query still gets its own top k."""
    df, m = vecs
    out = {0: set(range(296)), 1: {5, 6}, 7: set()}
    pairs = spark.createDataFrame([(q, d) for q, ds in out.items() for d in ds], "query_id long, doc_id long")
    for cells in (None, 16 * 50):
        got = as_lists(D.dense_search(df, df, 6, exclude_self=True, excluded=pairs, block_cells=cells))
        want = brute(m, 300)
        assert got == {q: [d for d in ds if d not in out.get(q, ())][:6] for q, ds in want.items()}


def _recall(approx, exact, k):
    hits = sum(len(set(approx.get(q, [])) & set(exact[q])) for q in exact)
    return hits / (k * len(exact))


def test_ann_and_quantised_recall(spark):
    from docsift.sources.fixtures import fx3_vectors

    v = fx3_vectors(spark, SF01).select("id", "embedding")
    exact = as_lists(D.dense_search(v, v, 10, exclude_self=True))
    sq = as_lists(D.sq_search(v, v, 10, exclude_self=True))
    assert _recall(sq, exact, 10) > 0.9


@pytest.mark.parametrize("key", ["ann_search", "pq_search", "pca_search", "pca_pq_search"])
def test_registered_searches_reach_recall(spark, key):
    from docsift.plans.catalog import QUERIES
    from docsift.sources.fixtures import fx3_vectors

    v = fx3_vectors(spark, SF01).select("id", "embedding")
    exact = as_lists(D.dense_search(v, v, 10, exclude_self=True))
    found = _recall(as_lists(QUERIES[key](spark, SF01)), exact, 10)
    print(f"recall@10 {key} {found:.4f}")
    assert found >= 0.9


def test_ann_multi_probe_recall(spark):
    from docsift.sources.fixtures import fx3_vectors

    v = fx3_vectors(spark, SF01).select("id", "embedding")
    exact = as_lists(D.dense_search(v, v, 10, exclude_self=True))
    ann = as_lists(D.ann_search(v, v, 10, n_tables=4, n_bits=4, exclude_self=True, flips=1))
    assert _recall(ann, exact, 10) >= 0.9


def test_ann_hot_bucket_chunking(spark, vecs):
    """A bucket split into many chunks gives the same answer as one chunk."""
    df, _ = vecs
    a = as_lists(D.ann_search(df, df, 5, n_tables=2, n_bits=2, chunk_rows=10))
    b = as_lists(D.ann_search(df, df, 5, n_tables=2, n_bits=2, chunk_rows=100000))
    assert a == b


def test_pca_orthonormal_and_variance(spark, vecs):
    df, m = vecs
    comps, share = Q.pca_fit(df, 6, rounds=400)
    assert np.allclose(comps @ comps.T, np.eye(6), atol=1e-9)
    cov = np.cov(m.T, bias=True)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(share, values[:6] / values.sum(), atol=2e-3) and share.sum() <= 1
    n, mean, got = Q.moments(df)
    assert n == len(m) and np.allclose(mean, m.mean(axis=0)) and np.allclose(got, cov)
    y = {r["id"]: r["embedding"] for r in Q.pca_project(comps, df).collect()}
    assert np.allclose(y[9], comps @ m[9])
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "id long, embedding array<double>")
    assert len(Q.pca_fit(flat, 3)[0]) == 1  # one direction of variance only


def lloyd(x, ids, k, rounds):
    """The documented k-means in plain numpy."""
    import hashlib
    order = sorted(range(len(ids)), key=lambda i: (hashlib.md5(f"42:{ids[i]}".encode()).hexdigest(), ids[i]))
    c = x[order[:k]].copy()
    for _ in range(rounds):
        a = Q.distances(x, c).argmin(axis=1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = x[a == j].mean(axis=0)
    return c


def test_kmeans_by_hash_order_and_fixed_rounds(spark, vecs):
    df, m = vecs
    got = Q.kmeans(df.repartition(7), 9, 4, m=2)
    for j in range(2):
        assert np.allclose(got[j], lloyd(m[:, 8 * j:8 * j + 8], range(300), 9, 4))
    assert np.allclose(got, Q.kmeans(df.coalesce(1), 9, 4, m=2))
    assert Q.kmeans(df.where("id < 3"), 9, 4).shape == (1, 3, 16)
    with pytest.raises(ValueError):
        Q.kmeans(df, 4, 1, m=3)
    with pytest.raises(ValueError):
        Q.kmeans(df.limit(0), 4, 1)


def test_lookup_tables_equal_decoded_products(spark, vecs, monkeypatch):
    df, m = vecs
    books = Q.kmeans(df, 8, 3, m=4)
    codes = np.stack([Q.distances(m[:, 4 * j:4 * j + 4], books[j]).argmin(axis=1) for j in range(4)], axis=1)
    decoded = np.concatenate([books[j][codes[:, j]] for j in range(4)], axis=1)
    scores = m @ decoded.T
    want = {q: [d for _, d in sorted((-round(scores[q, d], 6), d) for d in range(300) if d != q)[:9]] for q in range(300)}
    assert as_lists(Q.pq_scan(df, Q.pq_codes(df, books), books, 9, exclude_self=True)) == want
    monkeypatch.setattr(D, "BLOCK_CELLS", 32 * 50)
    assert as_lists(Q.pq_scan(df, Q.pq_codes(df, books), books, 9, exclude_self=True)) == want
    full = as_lists(Q.pq_search(df, df, 5, m=4, n_centroids=8, rounds=3, depth=300, exclude_self=True))
    assert full == brute(m, 5)  # at full depth the exact rank decides alone


def test_inverted_file_probes_and_hot_lists(spark, vecs):
    df, m = vecs
    assert as_lists(Q.ivf_search(df, df, 5, n_lists=6, n_probe=6, rounds=2, exclude_self=True)) == brute(m, 5)
    few = Q.ivf_search(df, df, 5, n_lists=6, n_probe=2, rounds=2)
    assert as_lists(few) == as_lists(Q.ivf_search(df, df, 5, n_lists=6, n_probe=2, rounds=2, chunk_rows=7))
    centres = lloyd(m, range(300), 6, 2)
    near = np.argsort(Q.distances(m, centres), axis=1, kind="stable")
    lists = {r["id"]: r["l"] for r in Q.ivf_lists(df, centres, 2).groupBy("id").agg(F.sort_array(F.collect_list("list")).alias("l")).collect()}
    assert lists == {i: sorted(near[i, :2].tolist()) for i in range(300)}


def test_sparse_encoder_unit_norm(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, "")], "doc_id long, text string")
    v = D.encode_hashed_tfidf(docs, 8)
    norms = {r["id"]: r["n"] for r in v.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert set(norms) == {1, 2} and all(abs(n - 1) < 1e-9 for n in norms.values())


def test_emitted_rows_do_not_depend_on_the_batch_size(spark, vecs):
    """One running top-k per task: copies of a vector and short Arrow batches add no rows."""
    df = (vecs[0] if isinstance(vecs, tuple) else vecs)
    df = df.unionByName(df.selectExpr("id + 100000 AS id", "embedding")).coalesce(1)
    key, n = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for rows in ("10000", "7"):
        spark.conf.set(key, rows)
        table = df.toPandas()
        schema = D.hit_schema(df.schema["id"].dataType, df.schema["id"].dataType)
        hits = D.dense_hits(table["id"].to_numpy(), D.stack(table["embedding"]), df.repartition(1), schema, 5, exclude_self=True)
        n.append((hits.count(), hits.distinct().count()))
    spark.conf.unset(key)
    assert n[0] == n[1] and n[0][0] == n[0][1]


def test_searches_hold_a_chunk_of_queries_alone(spark, vecs, monkeypatch):
    """Deep searches go in chunks bounded by the rows they keep; candidates are ranked exactly without a join."""
    df, m = vecs
    want = {q: as_lists(f()) for q, f in (("pca", lambda: Q.pca_search(df, df, 5, 6, 5, 20, exclude_self=True)),
                                          ("pq", lambda: Q.pq_search(df, df, 5, 4, 8, 3, 20, exclude_self=True)))}
    monkeypatch.setattr(D, "CHUNK_HITS", 20 * 40)
    assert D.chunk_count(df, 16, 20) == 8
    run = Q.pca_search(df, df, 5, 6, 5, 20, exclude_self=True)
    assert as_lists(run) == want["pca"] and as_lists(Q.pq_search(df, df, 5, 4, 8, 3, 20, exclude_self=True)) == want["pq"]
    assert "Join" not in run._jdf.queryExecution().executedPlan().toString()
    comps, _ = Q.pca_fit(df, 6, 5)
    near, exact = (m @ comps.T) @ (m @ comps.T).T, m @ m.T
    for q in range(300):
        deep = sorted((-round(near[q, d], 6), d) for d in range(300) if d != q)[:20]
        assert want["pca"][q] == [d for _, d in sorted((-round(exact[q, d], 6), d) for _, d in deep)[:5]]


def test_running_top_is_bounded_and_rounds_as_spark(spark):
    from docsift.functions.vectors import RunningTopK, half_up
    rng = np.random.default_rng(1)
    top = RunningTopK(np.arange(50), rng.standard_normal((50, 4)), 10)
    for i in range(40):
        top.add(np.arange(i * 100, i * 100 + 100), rng.standard_normal((100, 4)))
        assert sum(len(p[0]) for p in top.parts[0]) <= 2 * 10 * 50
    scores = [0.1234565, -0.1234565, 2.5e-6, 0.1234564999, 1e-9, 1234.5678905, 3.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, x double").selectExpr("i", "round(x, 6) AS r").orderBy("i").collect()
    assert half_up(np.array(scores)).tolist() == [r["r"] for r in got]


def test_sparse_vectors_are_exchanged_once(spark):
    """Sums, norms, their join and dense rows share one exchange by id."""
    tf = spark.createDataFrame([(i, f"t{j}", 1 + j % 3) for i in range(20) for j in range(i % 7 + 1)], "id long, term string, tf long")
    idf = spark.createDataFrame([(f"t{j}", 5, 1.0 + j) for j in range(7)], "term string, df long, idf double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = D.to_dense(D.encode_sparse(tf, idf, 8), 8)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    by_id = [line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line]
    assert by_id and all("REPARTITION_BY_NUM" in line for line in by_id), plan


def test_sparse_weights_are_computed_once_and_stay_with_their_document(spark):
    """One shuffle by term and one back of the rare terms' postings; norms add no second copy, frequent terms' postings stay."""
    from docsift.operators import lexical as L

    corpus = spark.createDataFrame([(i, f"a b{i % 3} c{i % 40} d{i} e e") for i in range(200)], "doc_id long, text string")
    idx = L.bm25_index(corpus)
    tf, idf = D.term_stats(corpus, index=idx)
    want = {(r["id"], r["dim"]): r["w"] for r in D.encode_sparse(tf, idf, 32).collect()}
    for heavy in (4, 10 ** 6):
        out = D.encode_sparse(tf, idf, 32, heavy=heavy, n_parts=D._parts_of(idx))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") <= 1 and "Exchange hashpartitioning(id#" not in plan.split("Union")[0], plan
        got = {(r["id"], r["dim"]): r["w"] for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    norms = {}
    for (i, _), w in want.items():
        norms[i] = norms.get(i, 0) + w * w
    assert len(norms) == 200 and all(abs(x - 1) < 1e-9 for x in norms.values())


def test_spread_does_not_run_a_shuffle_to_count_its_partitions(spark):
    from docsift.session import spread

    shuffled = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert spread(shuffled, 64) is shuffled
    assert spread(spark.range(0, 10, 1, 1), 4).rdd.getNumPartitions() == 4


def test_few_queries_share_the_corpus_among_tasks(spark):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-3, 4, (300, 6)).astype(float)  # many ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    queries = corpus.where("id < 5")
    run = D.dense_search(queries, corpus, 7, exclude_self=True, excluded=spark.createDataFrame([(0, 9), (4, 11)], "query_id long, doc_id long"))
    out = {(0, 9), (4, 11)} | {(i, i) for i in range(5)}
    for q in range(5):
        want = sorted((-float(vectors[q] @ vectors[d]), d) for d in range(300) if (q, d) not in out)[:7]
        assert [(-r["score"], r["doc_id"]) for r in run.where(F.col("query_id") == q).orderBy("rank").collect()] == want
    assert run._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    tasks = "shuffle_partition_id(_c" if "shuffle_partition_id(_c" in run._jdf.queryExecution().executedPlan().toString() else "_c"
    parts = [line for line in run._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and tasks in line]
    assert parts and "(_c" in parts[0] and ", 1)" not in parts[0], parts
