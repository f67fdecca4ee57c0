"""Run evaluation (#57-#66): NDCG, MAP, Recall, Precision, MRR, capped recall and hole @k.

Per query q with judged-relevant set R (relevance > 0), rel(i) in {0,1} at rank i
and hits@k = sum_{i<=k} rel(i):

    P@k      = hits@k / k
    Recall@k = hits@k / |R|
    MAP@k    = (1/|R|) * sum_{i<=k} rel(i) * hits@i / i
    NDCG@k   = sum_{i<=k} rel(i)/log2(i+1)  /  sum_{i<=min(k,|R|)} 1/log2(i+1)
    MRR@k    = 1 / (first relevant rank) if <= k else 0
    R_cap@k  = hits@k / min(k, |R|)
    Hole@k   = (# of the first k retrieved docs judged for no query) / k

Means are over the queries present in both the run and the qrels
(``denominator='retrieved'``) or over every judged query with missing = 0
(``'judged'``); values are rounded to 5 decimals.

Plan: the run is joined with the (query, doc) relevance flags and the set of
judged docs, one window computes running hits per query, k values are
exploded (k <= 100 rows per query), and one aggregation per (query, k) gives
every metric, so the whole report needs a single shuffle on query_id plus the
joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift import constants as C

METRICS = ("ndcg", "map", "recall", "precision", "mrr", "recall_cap", "hole")


def _idcg(k_col, nrel_col):
    return F.aggregate(F.sequence(F.lit(1), F.least(k_col, nrel_col)), F.lit(0.0),
                       lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))


def drop_self_hits(run: DataFrame) -> DataFrame:
    """Remove doc_id = query_id rows and close the rank gaps (a window over <= k rows per query)."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return (run.where(F.col("doc_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(w)))


def per_query_metrics(run: DataFrame, qrels: DataFrame, k_values=C.K_VALUES, exclude_self: bool = False) -> DataFrame:
    """(query_id, k, n_rel, ndcg, map, recall, precision, mrr, recall_cap, hole) per evaluated query.

    ``exclude_self`` drops a query's own id from its run first (document-to-document runs).
    """
    if exclude_self:
        run = drop_self_hits(run)
    kmax = max(k_values)
    rel = (qrels.where(F.col("relevance") > 0).select("query_id", "doc_id").distinct()
           .withColumn("is_rel", F.lit(1)))
    nrel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    judged = qrels.select("doc_id").distinct().withColumn("judged", F.lit(1))
    r = (run.where(F.col("rank") <= kmax).select("query_id", "doc_id", "rank")
         .join(nrel, "query_id")
         .join(rel, ["query_id", "doc_id"], "left")
         .join(judged, "doc_id", "left")
         .select("query_id", "rank", "n_rel", F.coalesce("is_rel", F.lit(0)).alias("rel"),
                 F.coalesce("judged", F.lit(0)).alias("judged")))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("cum_hits", F.sum("rel").over(w))
    r = r.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in k_values]))).where(F.col("rank") <= F.col("k"))
    g = (r.groupBy("query_id", "k", "n_rel")
         .agg(F.sum("rel").alias("hits"),
              F.sum(F.col("rel") / F.log2(F.col("rank") + F.lit(1))).alias("dcg"),
              F.sum(F.col("rel") * F.col("cum_hits") / F.col("rank")).alias("ap"),
              F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rel"),
              F.sum(F.lit(1) - F.col("judged")).alias("unjudged")))
    return g.select(
        "query_id", F.col("k").cast("bigint").alias("k"), "n_rel",
        (F.col("dcg") / _idcg(F.col("k"), F.col("n_rel"))).alias("ndcg"),
        (F.col("ap") / F.col("n_rel")).alias("map"),
        (F.col("hits") / F.col("n_rel")).alias("recall"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0)).alias("mrr"),
        (F.col("hits") / F.least(F.col("k"), F.col("n_rel"))).alias("recall_cap"),
        (F.col("unjudged") / F.col("k")).alias("hole"))


def _judged_fill(pq: DataFrame, qrels: DataFrame, k_values) -> DataFrame:
    """Add zero rows for judged queries that have no run rows (denominator='judged')."""
    judged_q = qrels.where(F.col("relevance") > 0).select("query_id").distinct()
    ks = (judged_q.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in k_values])))
          .withColumn("k", F.col("k").cast("bigint")))
    missing = ks.join(pq.select("query_id").distinct(), "query_id", "left_anti")
    zeros = missing.select("query_id", "k", F.lit(None).cast("bigint").alias("n_rel"),
                           *[F.lit(0.0).alias(m) for m in METRICS])
    return pq.unionByName(zeros)


def check_overlap(run: DataFrame, qrels: DataFrame) -> int:
    """Number of queries present in both the run and the qrels; warns when it is 0
    (e.g. test queries evaluated against train-only judgments)."""
    import warnings

    n = (run.select("query_id").distinct()
         .join(qrels.where(F.col("relevance") > 0).select("query_id").distinct(), "query_id").count())
    if n == 0:
        warnings.warn("run and qrels share no query: every metric would be empty", RuntimeWarning, stacklevel=2)
    return n


def evaluate_run(run: DataFrame, qrels: DataFrame, k_values=C.K_VALUES, denominator: str = "retrieved",
                 exclude_self: bool = False, warn_empty: bool = False) -> DataFrame:
    """One row per k: (k, n_queries, ndcg, map, recall, precision, mrr, recall_cap, hole).

    ``warn_empty`` runs :func:`check_overlap` first (one small action).
    """
    if warn_empty:
        check_overlap(run, qrels)
    pq = per_query_metrics(run, qrels, k_values, exclude_self)
    if denominator == "judged":
        pq = _judged_fill(pq, qrels, k_values)
    return (pq.groupBy("k")
            .agg(F.count(F.lit(1)).alias("n_queries"),
                 *[F.round(F.avg(m), C.METRIC_DECIMALS).alias(m) for m in METRICS]))


def evaluate_metric(run: DataFrame, qrels: DataFrame, metric: str, k_values=C.K_VALUES) -> DataFrame:
    """Single metric report ``(k, value)`` (``evaluate_custom(metric=...)`` analogue)."""
    rep = evaluate_run(run, qrels, k_values)
    return rep.select("k", F.col(metric).alias("value"))


def evaluate_by_language(run: DataFrame, qrels: DataFrame, query_language: DataFrame,
                         k_values=C.K_VALUES) -> DataFrame:
    """Per-language report plus the all-language row (language = 'all') in one grouping-sets pass.

    ``query_language`` is (query_id, language).
    """
    pq = per_query_metrics(run, qrels, k_values).join(query_language.select("query_id", "language"), "query_id")
    aggs = [F.count(F.lit(1)).alias("n_queries")] + [F.round(F.avg(m), C.METRIC_DECIMALS).alias(m) for m in METRICS]
    rep = pq.groupingSets([["language", "k"], ["k"]], "language", "k").agg(*aggs)
    return rep.select(F.coalesce("language", F.lit("all")).alias("language"), "k", "n_queries", *METRICS)


def metrics_long(report: DataFrame, id_cols=("k",)) -> DataFrame:
    """Wide report -> long form (…, metric, value) with ``stack``."""
    pairs = ", ".join(f"'{m}', {m}" for m in METRICS)
    return report.selectExpr(*id_cols, f"stack({len(METRICS)}, {pairs}) as (metric, value)")
