from pyspark.sql import functions as F

from docsift.operators import prepare as P
from tests.conftest import rows


def _qrels(spark, data):
    return spark.createDataFrame([(q, d, lang, 1) for q, d, lang in data],
                                 "query_id long, doc_id long, language string, relevance int")


def test_merge_right_wins_replaces_whole_set(spark):
    a = _qrels(spark, [(1, 10, "de"), (1, 11, "de"), (2, 20, "de")])
    b = _qrels(spark, [(1, 12, "fr")])
    out = rows(P.merge_qrels_right_wins(a, b), "query_id", "doc_id")
    assert out == [(1, 12), (2, 20)]


def test_create_subset_rules(spark):
    corpus = spark.createDataFrame([(10, "long enough text"), (11, "short"), (20, "another long text")],
                                   "doc_id long, text string")
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, text string")
    qrels = _qrels(spark, [(1, 10, None), (1, 11, None), (2, 20, None)])
    q_last, r_last, c_last, short = P.create_subset(5, queries, qrels, corpus, rule="last")
    q_any, *_ = P.create_subset(5, queries, qrels, corpus, rule="any")
    assert rows(q_last, "query_id") == [(2,)]          # query 1's last doc (11) is short
    assert rows(q_any, "query_id") == [(1,), (2,)]
    assert rows(c_last, "doc_id") == [(10,), (20,)]
    assert short.first()["short"] == 1
    # n + 1 queries are walked
    q1, *_ = P.create_subset(0, queries, qrels, corpus, rule="any")
    assert rows(q1, "query_id") == [(1,)]


def test_hash_split_disjoint_and_complete(spark):
    q = spark.range(0, 2000).withColumnRenamed("id", "query_id")
    s = P.split_queries(q)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(counts.values()) == 2000 and 120 < counts["train"] < 280
    assert s.select("query_id").distinct().count() == 2000


def test_global_index_contiguous(spark):
    df = spark.range(0, 1000).select(F.md5(F.col("id").cast("string")).alias("k"), "id").repartition(7)
    idx = P.global_index(df, "k", partitions=5)
    got = [r["idx"] for r in idx.orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_first_n_and_closure(spark):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "query_id long, text string")
    qrels = _qrels(spark, [(i, 100 + i, None) for i in range(0, 10, 2)])
    first = rows(P.first_n_judged(queries, qrels, 2), "query_id")
    assert first == [(0,), (2,)]
    corpus = spark.createDataFrame([(100 + i, "t") for i in range(10)], "doc_id long, text string")
    _, r, c = P.closure_subset(queries.where("query_id < 5"), qrels, corpus)
    assert rows(c, "doc_id") == [(100,), (102,), (104,)]
    assert r.join(c, "doc_id", "left_anti").count() == 0


def test_split_ordered(spark):
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "query_id long, text string")
    qrels = _qrels(spark, [(i, 100, None) for i in range(10) if i != 3])
    s = dict(rows(P.split_ordered(queries, qrels, 0.3), "query_id", "split"))
    assert [q for q, v in s.items() if v == "train"] == [0, 1, 2]
    assert s[3] == "dropped" and s[4] == "test"


def test_merge_union_mode_and_unseeded_split(spark):
    a = _qrels(spark, [(1, 10, "de"), (2, 20, "de")])
    b = _qrels(spark, [(1, 12, "fr"), (1, 10, "fr")])
    assert rows(P.merge_qrels_right_wins(a, b, mode="union"), "query_id", "doc_id") == [(1, 10), (1, 12), (2, 20)]
    q = spark.range(0, 500).withColumnRenamed("id", "query_id")
    s = P.split_queries(q, seed=None)
    assert s.count() == 500 and set(r["split"] for r in s.collect()) <= {"train", "test"}


def test_create_dataset_composition(spark):
    queries = spark.createDataFrame([(1, "The court and the judge", "en"), (2, "Der Richter und das Gericht", "de")],
                                    "query_id long, text string, language string")
    corpus = spark.createDataFrame([(10, "", "und das lange Urteil", "de"), (11, "", "kurz", "de"), (12, "", "x", "en")],
                                   "doc_id long, title string, text string, language string")
    qrels = _qrels(spark, [(2, 10, "de"), (2, 11, "de"), (1, 12, "en")])
    q, r, c = P.create_dataset(queries, qrels, corpus, "de", "german", remove_stopwords=True, use_subset=True,
                               subset_length=5, subset_rule="any")
    assert rows(q, "query_id", "text") == [(2, "Richter Gericht")]
    assert rows(c, "doc_id", "text") == [(10, "lange Urteil")]
    assert rows(r, "query_id", "doc_id") == [(2, 10), (2, 11)]
