"""The stored index: versions, load-if-present, pruned reads, deletes and appends."""

import glob
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docsift.operators import lexical as L
from docsift.operators import lexical_store
from docsift.operators.lexical_store import IncompleteIndex, LexicalStore, open_or_create
from docsift.session import scratch_path
from tests.test_lexical import DOCS, QUERIES, as_dict


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


def contents(index):
    return (sorted(tuple(r) for r in index.postings.select("term", "doc_id", "tf", "dl").collect()),
            sorted((r["term"], r["df"], round(r["idf"], 9)) for r in index.terms.collect()), index.n_docs, round(index.avgdl, 9))


def test_a_second_call_loads_and_a_half_written_folder_is_refused(spark, corpus, queries):
    path = scratch_path(spark, "store")
    os.makedirs(f"{path}/seg-dead/postings")
    os.makedirs(f"{path}/versions/v=7")  # a writer that died: no mark
    with pytest.raises(IncompleteIndex):
        LexicalStore(spark, path).read()
    store, loaded = open_or_create(spark, path, lambda: corpus)
    assert not loaded

    def never():
        raise AssertionError("built again")
    again, loaded = open_or_create(spark, path, never)
    assert loaded and contents(again.read()) == contents(L.bm25_index(corpus))
    assert as_dict(L.bm25_search(again.read(), queries, 3)) == as_dict(L.bm25_search(L.bm25_index(corpus), queries, 3))


def test_only_parts_with_asked_terms_are_read(spark, queries):
    words = [f"t{i:03d}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 20])) for i in range(180)], "doc_id long, text string")
    store = LexicalStore(spark, scratch_path(spark, "store")).create(docs)
    asked = spark.createDataFrame([(1, "t005 t006"), (2, "t004")], "query_id long, text string")
    few = store.read(asked)
    segment = store.version()["segments"][0]
    every = {r["part"] for r in spark.read.parquet(f"{store.path}/{segment}/parts").collect()}
    plan = store._postings([segment], asked.select(F.explode(F.split("text", " ")).alias("term")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    pruned = {int(x) for x in re.findall(r"\d+", re.search(r"PartitionFilters: \[.*?part#\d+ (?:IN|=) ([^\]]*)\]", text)[1])}
    assert pruned < every and len(every) > 2 and len(pruned) <= 2
    assert as_dict(L.bm25_search(few, asked, 4)) == as_dict(L.bm25_search(L.bm25_index(docs), asked, 4))
    none = store.read(spark.createDataFrame([(1, "zzz")], "query_id long, text string"))
    assert none.postings.count() == 0 and none.n_docs == 180


def test_deletes_and_appends_equal_a_rebuild(spark, corpus, queries):
    store = LexicalStore(spark, scratch_path(spark, "store")).create(corpus)
    store.delete(spark.createDataFrame([(1,), (4,), (7,), (99,)], "doc_id long"))
    left = corpus.where("doc_id NOT IN (1, 4, 7)")
    assert contents(store.read()) == contents(L.bm25_index(left))
    store.append(corpus.where("doc_id IN (1, 4, 7)"))
    assert contents(store.read()) == contents(L.bm25_index(corpus))
    changed = spark.createDataFrame([(2, "an entirely new garden text"), (20, "tenant tenant garden")], "doc_id long, text string")
    store.append(changed)
    now = corpus.where("doc_id <> 2").unionByName(changed)
    assert contents(store.read()) == contents(L.bm25_index(now))
    assert as_dict(L.bm25_search(store.read(queries), queries, 3)) == as_dict(L.bm25_search(L.bm25_index(now), queries, 3))
    store.delete(now.select("doc_id"))
    assert store.read().n_docs == 0 and L.bm25_search(store.read(), queries, 3).count() == 0
    store.create(corpus)  # a new index replaces all versions
    assert contents(store.read()) == contents(L.bm25_index(corpus))
    assert LexicalStore(spark, scratch_path(spark, "store")).create(corpus.limit(0)).read().n_docs == 0


def test_partitions_and_parts_follow_the_input_and_a_frequent_term_is_split(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"often w{i} " + "often " * 3) for i in range(2000)], "doc_id long, text string")
    whole = contents(L.bm25_index(docs))
    n = L.shuffle_partitions(docs)
    monkeypatch.setattr(L, "PARTITION_BYTES", 2_500)
    monkeypatch.setattr(L, "PARTITION_TOKENS", 500)
    index = L.bm25_index(docs)
    assert index.postings.rdd.getNumPartitions() >= 2 * n and contents(index) == whole
    store = LexicalStore(spark, scratch_path(spark, "store")).create(docs)
    segment = store.version()["segments"][0]
    parts = spark.read.parquet(f"{store.path}/{segment}/parts").where("first <= 'often' AND last >= 'often'").count()
    assert parts >= n // 2
    read = store.read()
    assert read.postings.rdd.getNumPartitions() >= 2 * n and contents(read) == whole
    asked = spark.createDataFrame([(1, "often w7")], "query_id long, text string")
    assert as_dict(L.bm25_search(store.read(asked), asked, 4)) == as_dict(L.bm25_search(index, asked, 4))


def test_changes_read_documents_not_postings_and_parts_are_sorted_once(spark, corpus, monkeypatch):
    store = LexicalStore(spark, scratch_path(spark, "store")).create(corpus)

    def never(*_):
        raise AssertionError("postings are read")
    with monkeypatch.context() as m:
        m.setattr(LexicalStore, "_postings", never)
        store.delete(spark.createDataFrame([(1,), (4,), (7,)], "doc_id long"))
        store.append(corpus.where("doc_id IN (1, 4, 7)"))
    index = store.read(storage=None)
    assert not index.postings.is_cached and not index.terms.is_cached
    assert contents(index) == contents(L.bm25_index(corpus))
    for segment in store.version()["segments"]:
        for part in sorted(glob.glob(f"{store.path}/{segment}/postings/part=*/*.parquet".removeprefix("file:"))):
            keys = [(r["term"], r["doc_id"]) for r in pq.read_table(part, columns=["term", "doc_id"]).to_pylist()]
            assert keys == sorted(keys)


def test_segments_are_counted_in_small_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} often") for i in range(500)], "doc_id long, text string")
    seen, build = [], L.bm25_index

    def watched(*args, **kwargs):
        seen.append(build(*args, **kwargs))
        return seen[-1]
    monkeypatch.setattr(lexical_store, "SEGMENT_BYTES", 200)
    monkeypatch.setattr(L, "bm25_index", watched)
    store = LexicalStore(spark, scratch_path(spark, "store")).create(docs)
    assert seen[0].postings.rdd.getNumPartitions() >= 2 * L.shuffle_partitions(docs)
    assert contents(store.read()) == contents(build(docs))
