"""The experiment grid on shared statistics against one plain BM25 index per cell."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.postings import Forms
from docsift.functions.text import remove_stopwords, tokenize
from docsift.operators import evaluate as E
from docsift.operators import lexical as L
from docsift.operators import prepare as P
from docsift.operators import rerank as R
from docsift.plans import experiments as X

DOCS = [(1, "das Gericht hat die Beschwerde des Mieters abgewiesen", "de"), (2, "der Mieter zahlt die Miete und das Gericht", "de"),
        (3, "le tribunal rejette le recours du locataire", "fr"), (4, "les locataires et le tribunal", "fr"), (5, "", "de"),
        (6, None, "fr"), (7, "the court dismissed the appeal of the tenant", "en"), (8, "das das die der", "de"),
        (9, "tribunal tribunal Gericht court", None), (10, "Gericht Miete Mieters Beschwerde Gericht", "de")]
QUERIES = [(100, "das Gericht und die Mieter", "de"), (101, "Beschwerden", "de"), (102, "le tribunal du locataire", "fr"),
           (103, "the court tribunal Gericht", "mixed"), (104, None, "de"), (105, "unbekannt", "de")]
QRELS = [(100, 2, "de", 1), (100, 10, "de", 1), (101, 1, "de", 1), (102, 3, "fr", 1), (102, 4, "fr", 1), (103, 9, "mixed", 1), (104, 5, "de", 1)]
CELLS = (X.Cell("raw", "all"), X.Cell("de", "de"), X.Cell("de_s", "de", None, ("german",)), X.Cell("de_an", "de", "german"),
         X.Cell("all_an_s", "all", "german", ("french", "german")), X.Cell("fr", "fr", "french"), X.Cell("some", "some"),
         X.Cell("none", "none"))


@pytest.fixture(scope="module")
def data(spark):
    corpus = spark.createDataFrame(DOCS, "doc_id long, text string, language string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string, language string")
    qrels = spark.createDataFrame(QRELS, "query_id long, doc_id long, language string, relevance int")
    in_ = lambda df, x: df.where(F.col("language") == x)
    slices = {"all": X.Slice(queries, qrels), "none": X.Slice(queries, qrels, F.lit(False))}
    slices |= {x: X.Slice(in_(queries, x), in_(qrels, x), F.col("language") == x) for x in ("de", "fr")}
    q, r, c, _ = P.create_subset(2, queries, qrels, corpus)
    slices["some"] = X.Slice(q, r, c.select("doc_id"))
    return corpus, slices


def plain(corpus, slices, cell, k=100):
    """The cell by an index of its own, as the experiments do it."""
    s = slices[cell.slice]
    docs = corpus.join(s.docs, "doc_id", "left_semi") if isinstance(s.docs, DataFrame) else corpus if s.docs is None else corpus.where(s.docs)
    queries = s.queries
    if cell.stopwords:
        docs, queries = (df.withColumn("text", remove_stopwords("text", cell.stopwords)) for df in (docs, queries))
    return L.bm25_search(L.bm25_index(docs, analyzer=cell.analyzer), queries, k), docs, queries


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize("block_bytes,segment", [(L.BLOCK_BYTES, 1 << 20), (1, 3)])
def test_every_cell_equals_its_own_index(spark, data, block_bytes, segment):
    corpus, slices = data
    grid = X.Grid(corpus, slices, CELLS)
    run = grid.search(block_bytes=block_bytes, segment_postings=segment)
    for i, cell in enumerate(CELLS):
        assert rows(run.where(F.col("cell") == i)) == rows(plain(corpus, slices, cell)[0]), cell.name
    assert run.where(F.col("cell") == 7).count() == 0


def test_shared_postings_are_one_table_without_an_exchange_per_cell(spark, data):
    corpus, slices = data
    grid = X.Grid(corpus, slices, CELLS)
    terms = (grid.query_terms().select(F.struct("cell", "query_id").alias("query_id"),
                                       F.concat_ws(" ", "analyzer", "term").alias("term"), "w").persist())
    terms.count()
    plan = grid._block_hits(terms, 5, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    head = plan.split("InMemoryTableScan")[0]
    assert "Exchange hashpartitioning" not in head and head.count("MapInArrow") == 1


def test_reports_and_reranks(spark, data):
    corpus, slices = data
    grid = X.Grid(corpus, slices, CELLS)
    rerank = (X.RerankCell("pairs", "some", "pairs"), X.RerankCell("dense", "de", "dense"))
    out = {(r["experiment"], r["k"]): r for r in X.experiment_grid(grid, rerank).collect()}
    assert {n for n, _ in out} == {c.name for c in CELLS[:-1]} | {"pairs", "dense"}
    for cell in CELLS[:-1]:
        run, _, _ = plain(corpus, slices, cell)
        for r in E.evaluate_run(run, slices[cell.slice].qrels).collect():
            got = out[cell.name, r["k"]]
            assert got["slice"] == cell.slice and all(got[m] == r[m] for m in (*E.METRICS, "n_queries")), (cell.name, r["k"])
    first, docs, queries = plain(corpus, slices, CELLS[6])
    again = R.rerank_pairs(first, queries, docs, index=L.bm25_index(docs))
    for r in E.evaluate_run(again, slices["some"].qrels).collect():
        got = out["pairs", r["k"]]
        assert all(got[m] == r[m] for m in E.METRICS if m != "recall_cap")
        assert got["recall_cap"] == out["some", r["k"]]["recall_cap"]  # of the first stage
    long = X.compare_runs(X.experiment_grid(grid, rerank), {"de": "de"}, "raw")
    for r in long.where("experiment IN ('de_s', 'fr')").collect():
        assert r["against"] == ("de" if r["slice"] == "de" else "raw") and r["delta"] == round(r["value"] - r["baseline"], 5)


def test_grid_limits(spark, data):
    corpus, slices = data
    with pytest.raises(ValueError):
        X.Grid(corpus, {str(i): slices["all"] for i in range(64)}, CELLS)
    grid = X.Grid(corpus, slices, CELLS)
    with pytest.raises(ValueError):
        grid.rerank(X.RerankCell("x", "raw", "other"), grid.search())


def test_words_are_counted_once_and_stemmed_once(spark, data):
    """Analyzers and stopword choices add no postings; each distinct word has one row of forms for each analyzer that keeps it."""
    corpus, slices = data
    grid = X.Grid(corpus, slices, CELLS)
    words = corpus.select("doc_id", F.explode(tokenize("text")).alias("w"))
    assert grid.postings.count() == words.distinct().count()
    assert grid.forms.groupBy("word", "analyzer").count().where("count > 1").count() == 0
    assert grid.forms.where("analyzer = ''").count() == words.select("w").distinct().count()
    wanted = grid.forms.select(F.concat_ws(" ", "analyzer", "stem").alias("term")).distinct()
    counts = [sorted(map(tuple, grid._document_counts(wanted, b).collect())) for b in (L.BLOCK_BYTES, 2000)]
    assert counts[0] and counts[0] == counts[1]
    nothing = X.Slice(slices["all"].queries.withColumn("text", F.lit(None).cast("string")), slices["all"].qrels)
    assert X.Grid(corpus, {"all": nothing}, CELLS[:1]).search().count() == 0


def test_forms_of_a_term_are_summed_by_document():
    docs, words = np.array([0, 0, 0, 1, 1]), np.array([0, 1, 2, 1, 2])
    forms = Forms(docs, words, np.array([[0, 1, 2], [4, 4, -1]]))  # the second analyzer joins words 0 and 1 and drops 2
    tf, out = np.array([1, 2, 4, 8, 16], np.int32), np.array([0, 1, 0, 1, 0])
    got = lambda *x: [y.tolist() for y in forms.counts(*x, tf, out)]
    assert got(1, 2) == [[0, 3], [4, 4], [3, 8]]
    assert got(1, 1) == [[0], [4], [1]]  # the kept words alone, and no document without one
    assert got(0, 1) == [[0, 2, 4], [0, 2, 2], [1, 4, 16]]
