"""Two-stage retrieval: rerank the first-stage top-k (#55, #56).

The expensive scorer only sees ``depth`` candidates per query (a WindowGroupLimit
on the first-stage run).  Default scorers are set-based joins, so they stay in
the JVM; a custom scorer is any pandas UDF ``(query_text, doc_text) -> double``,
applied Arrow-batched to the hydrated candidate pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions.text import normalize_text, tokenize
from docsift.operators.dense import sparse_dot
from docsift.operators.lexical import LexicalIndex, query_terms, rank_top_k, shuffle_partitions


def _finish(scored: DataFrame, k: int) -> DataFrame:
    return rank_top_k(scored, k).select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


def coverage_scores(pairs: DataFrame, index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """idf-weighted query-term coverage of each (query_id, doc_id) pair:
    sum of idf over distinct query terms present in the doc / sum of idf over distinct query terms.
    """
    qt = query_terms(queries, index).select("query_id", "term", "idf")
    total = qt.groupBy("query_id").agg(F.sum("idf").alias("total"))
    # the postings lie by document: only the candidates' ones leave their partitions, and (term, doc_id) is no hot key
    near = index.postings.select("term", "doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    present = (near.join(pairs.join(qt, "query_id"), ["term", "doc_id"])
               .groupBy("query_id", "doc_id").agg(F.sum("idf").alias("hit")))
    # left: a query without any indexed term keeps its candidates, at score 0
    return (pairs.join(present, ["query_id", "doc_id"], "left").join(total, "query_id", "left")
            .select("query_id", "doc_id", F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0)).alias("score")))


#: at every token boundary of " t1 t2 t3 ... " the lookahead captures the next two tokens,
#: so one regex pass yields every adjacent token pair (tokens never contain spaces)
_BIGRAM_REGEX = r"(?= ([^ ]+ [^ ]+) )"


def bigrams(text) -> Column:
    """Distinct adjacent token pairs ``"a b"`` of the tokenised text (array<string>).

    The normalised lower-cased text already is the token stream with single spaces
    (what ``tokenize`` splits), so it is padded and scanned directly.
    """
    padded = F.concat(F.lit(" "), F.trim(normalize_text(F.lower(text))), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(_BIGRAM_REGEX), 1))


def bigram_overlap(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """|distinct bigrams(query) & bigrams(doc)| per (query_id, doc_id).

    Each candidate document is tokenised once (semi-join with the candidate ids) and its bigram set extracted in one regex pass; each pair is then a hash-set
    intersection (``array_intersect``), all JVM-side.
    """
    qb = queries.select("query_id", bigrams(F.col("text")).alias("qbg"))
    cand = pairs.select("query_id", "doc_id").join(qb, "query_id")
    docs = (corpus.select("doc_id", "text").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
            .repartition(shuffle_partitions(corpus), "doc_id")
            .select("doc_id", bigrams(F.col("text")).alias("dbg")))
    return (docs.join(cand, "doc_id")
            .select("query_id", "doc_id", F.size(F.array_intersect("dbg", "qbg")).alias("overlap")))


def default_pair_scores(pairs: DataFrame, index: LexicalIndex, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Default pair scorer: idf-weighted query-term coverage * (1 + ln(1 + bigram overlap))."""
    cov = coverage_scores(pairs, index, queries)
    ov = bigram_overlap(pairs, queries, corpus)
    return (cov.join(ov, ["query_id", "doc_id"], "left")
            .select("query_id", "doc_id",
                    (F.col("score") * (F.lit(1.0) + F.log(F.lit(1.0) + F.coalesce("overlap", F.lit(0))))).alias("score")))


def rerank_pairs(run: DataFrame, queries: DataFrame, corpus: DataFrame, index: LexicalIndex | None = None,
                 scorer=None, depth: int = C.RERANK_DEPTH, k: int = C.RERANK_DEPTH) -> DataFrame:
    """Re-score the first ``depth`` candidates of each query with a pair scorer and re-rank.

    ``scorer``: None -> idf-weighted term coverage * (1 + ln(1 + bigram overlap)) (needs
    ``index``); or a pandas UDF taking (query_text, doc_text) columns and returning a double.
    """
    pairs = run.where(F.col("rank") <= depth).select("query_id", "doc_id")
    if scorer is None:
        scored = default_pair_scores(pairs, index, queries, corpus)
    else:
        hyd = (pairs.join(queries.select("query_id", F.col("text").alias("qt")), "query_id")
               .join(corpus.select("doc_id", F.col("text").alias("dt")), "doc_id"))
        scored = hyd.select("query_id", "doc_id", scorer(F.col("qt"), F.col("dt")).alias("score"))
    return _finish(scored, k)


def rerank_dense(run: DataFrame, qvec: DataFrame, dvec: DataFrame, depth: int = C.RERANK_DEPTH,
                 k: int = C.RERANK_DEPTH, candidate_scope: str = "per_query", dim: int | None = None) -> DataFrame:
    """Re-score the first ``depth`` candidates by the cosine of L2-normalised sparse vectors
    ``(id, dim, w)`` and re-rank.

    ``candidate_scope='per_query'``: each query scores its own candidates.
    ``'pooled'``: each query scores the union of all queries' candidates (needs ``dim``);
    it runs through the exact block top-k kernel, so only top-k rows are ever emitted.
    """
    pairs = run.where(F.col("rank") <= depth).select("query_id", "doc_id")
    if candidate_scope == "pooled":
        from docsift.operators.dense import dense_search, to_dense

        pool = pairs.select(F.col("doc_id").alias("id")).distinct()
        queries = to_dense(qvec.join(run.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi"), dim)
        return dense_search(queries, to_dense(dvec.join(pool, "id", "left_semi"), dim), k, "dot")
    # only candidate documents need vectors: at depth 100 that is a sliver of the corpus
    cand_ids = pairs.select(F.col("doc_id").alias("id")).distinct()
    scored = sparse_dot(pairs, qvec, dvec.join(cand_ids, "id", "left_semi"))
    scored = pairs.join(scored, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return _finish(scored, k)


def text_overlap_scorer() -> Column:
    """Example pluggable pair scorer (pandas UDF): Jaccard overlap of lower-cased word sets."""
    import re

    word = re.compile(r"\w+")

    @F.pandas_udf("double")
    def score(q: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(q, d):
            sa, sb = set(word.findall((a or "").lower())), set(word.findall((b or "").lower()))
            out.append(len(sa & sb) / len(sa | sb) if sa or sb else 0.0)
        return pd.Series(out)
    return score
