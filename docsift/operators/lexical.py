"""Lexical retrieval: inverted index build (#40), BM25 search (#41, #42), multi-search by document (#43).

BM25 (Robertson & Zaragoza 2009):
    score(q, d) = sum_t  qtf(t) * idf(t) * tf(t,d)*(k1+1) / (tf(t,d) + k1*(1 - b + b*dl(d)/avgdl))
    idf(t)      = ln(1 + (N - df(t) + 0.5) / (df(t) + 0.5))
N and avgdl are over documents with at least one token.  Scores are rounded to
6 decimals and ties broken by doc_id, so rankings are engine-independent.

One physical plan at every size:

* Index: ``postings(term, doc_id, tf, dl, impact)`` hash-partitioned by ``doc_id``.  Whole documents
  are shuffled by id once and tokenised after it, so counting tokens needs no exchange of its own, and
  a frequent term's postings lie in all partitions instead of one.
* Search: query terms go in blocks of bounded bytes.  A block is broadcast to the postings, which stay
  where they are.  A task streams its documents' postings of the asked terms in segments and scores every query of the
  block against them with a running top-k: by matrix products, or block maxima for few queries (``functions.postings``).  Only about k
  rows per query and partition leave the task; of many queries, only those that reach the k-th score of some partitions
  searched before.  The block size never changes results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift import constants as C
from docsift.functions.postings import MANY_QUERIES, SEGMENT_POSTINGS, Best, search_segment, segments
from docsift.functions.text import analyze, tokenize
from docsift.session import scratch_path

#: bytes of query terms in one broadcast block; a block of a single query may be larger
BLOCK_BYTES = 96 << 20
#: text or tokens of a partition of an index: larger inputs make more partitions, so a task's memory stays as it is
PARTITION_BYTES = 16 << 20
PARTITION_TOKENS = 2_500_000
#: bytes of a query-term row in a task (term number, weight, share of the query's id)
ROW_BYTES = 16
#: Parts of an index in which many queries are searched first, one for this many parts: the k-th best score found there
#: is a floor for the search of all parts, which then keep and exchange few documents below the final k-th score.
SEED_PARTS = 16


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, size: int, limit: int) -> int:
    """The session's shuffle partitions, or as many as ``size`` needs at ``limit`` each."""
    return max(shuffle_partitions(df), math.ceil(size / limit))


class LexicalIndex:
    """Postings partitioned by document, and term statistics."""

    def __init__(self, postings, terms, n_docs, avgdl, k1, b, analyzer, cached, n_parts: int = 1):
        #: partitions of the postings by hash of doc_id, where they are known
        self.n_parts = n_parts
        self.postings, self.terms = postings, terms
        self.n_docs, self.avgdl, self.k1, self.b = n_docs, avgdl, k1, b
        self.analyzer = analyzer
        self._cached = list(cached)

    def unpersist(self):
        for df in self._cached:
            df.unpersist()


def term_array(text: Column, analyzer: str | None) -> Column:
    return analyze(text, analyzer) if analyzer else tokenize(text)


def bm25_index(corpus: DataFrame, doc_id: str = "doc_id", text: str = "text", analyzer: str | None = None,
               k1: float = C.BM25_K1, b: float = C.BM25_B,
               storage: StorageLevel = StorageLevel.MEMORY_AND_DISK, partition_bytes: int | None = None) -> LexicalIndex:
    """Build postings and term statistics (persisted); one small action computes N and avgdl.

    Small partitions (``partition_bytes`` of text) count faster, but a search keeps about k rows a query in each.
    """
    size = corpus.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0
    n_parts = partitions_for(corpus, size, partition_bytes or PARTITION_BYTES)
    docs = (corpus.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
            .repartition(n_parts, "doc_id")
            .select("doc_id", term_array(F.col("_text"), analyzer).alias("toks")))
    # *_outer + a null filter on the generated column: a plain explode makes Catalyst infer
    # ``size(toks) > 0`` and push it below the repartition, tokenising twice (once in the scan task)
    tok = (docs.select("doc_id", F.size("toks").alias("dl"), F.posexplode_outer("toks").alias("pos", "term"))
           .where(F.col("term").isNotNull()))
    base = (tok.groupBy("doc_id", "term", "dl")
            .agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))
            .sortWithinPartitions("doc_id").persist(storage))
    # one posting per document has first_pos == 0, so N needs no distinct count
    stats = base.agg(F.count_if(F.col("first_pos") == 0).alias("n"), F.sum("tf").alias("tokens")).first()
    n_docs = int(stats["n"] or 0)
    avgdl = float(stats["tokens"] or 0) / n_docs if n_docs else 0.0
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl else 1.0))
    postings = base.select("term", "doc_id", "tf", "dl",
                           (F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)).alias("impact"))
    terms = (base.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
             .withColumn("idf", F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))
             .persist(storage))
    return LexicalIndex(postings, terms, n_docs, avgdl, k1, b, analyzer, (base, terms), n_parts)


def query_terms(queries: DataFrame, index: LexicalIndex, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, term, qtf, w = qtf*idf, df, idf) for query terms present in the index."""
    qt = (queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("_text"))
          .repartition(shuffle_partitions(queries), "query_id")
          .select("query_id", F.explode_outer(term_array(F.col("_text"), index.analyzer)).alias("term"))
          .where(F.col("term").isNotNull())
          .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    return (qt.join(index.terms.select("term", "df", "idf"), "term")
            .select("query_id", "term", "qtf", (F.col("qtf") * F.col("idf")).alias("w"), "df", "idf"))


def rank_top_k(scored: DataFrame, top_k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Keep the top ``top_k`` docs per query: round(score, 6) desc, doc_id asc (WindowGroupLimit)."""
    w = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(doc_id).asc())
    return (scored.withColumn("score", F.round("score", C.SCORE_DECIMALS))
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top_k))


def _hits_schema(query_type, doc_type) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("doc_id", doc_type),
                         T.StructField("score", T.DoubleType())])


def block_queries(block: DataFrame) -> tuple[list, DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """One block of query terms (query_id, term, w) for the kernel: query ids, a (term, tid) table to broadcast,
    and per query the run of its term numbers and weights.  No term passes through the driver more than once."""
    distinct = block.select("term").distinct().toArrow().column(0).combine_chunks()  # bounded: one block
    numbers = block.sparkSession.createDataFrame(
        pa.table({"term": distinct, "tid": pa.array(np.arange(len(distinct)), pa.int64())}))
    # a row a query, with its terms in lists; bounded: one block
    table = (block.join(F.broadcast(numbers), "term").groupBy("query_id")
             .agg(F.collect_list(F.col("tid").cast("int")).alias("t"), F.collect_list("w").alias("w")).toArrow())
    tids, weights = (table.column(i).combine_chunks() for i in (1, 2))
    lengths = tids.value_lengths().to_numpy(zero_copy_only=False)
    return (table.column(0).to_pylist(), numbers, np.append(0, np.cumsum(lengths, dtype=np.int64)),
            tids.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False))


def hits(found: list[tuple[object, Best]], schema) -> pa.RecordBatch:
    """The kept documents of every (query id, Best) as one batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(schema)]
    counts = [len(b.scores) for _, b in found]
    return pa.RecordBatch.from_arrays([
        pa.array([q for (q, _), n in zip(found, counts) for _ in range(n)], types[0]),
        pa.array([x for _, b in found for x in (b.ids.tolist() if len(b.scores) else ())], types[1]),
        pa.array(np.concatenate([b.scores for _, b in found] + [np.empty(0)]), types[2])], names=schema.names)


def block_hits(index: LexicalIndex, block: DataFrame, top_k: int, exclude_self: bool = False,
               segment_postings: int = SEGMENT_POSTINGS, seed_parts: int = 0) -> DataFrame:
    """(query_id, doc_id, score): each partition's documents that can be in the exact top k of a block's queries.

    With ``seed_parts`` that many of the index's partitions are searched first, for floors of the scores.
    """
    ids, numbers, runs, terms, weights = block_queries(block)
    sc = block.sparkSession.sparkContext
    schema = _hits_schema(block.schema["query_id"].dataType, index.postings.schema["doc_id"].dataType)
    n_terms = int(terms.max(initial=-1)) + 1
    queries = sc.broadcast((ids, runs, terms, weights))

    def search(postings, floors):
        floors = sc.broadcast(floors)

        def task(batches):
            ids, runs, terms, weights = queries.value
            best = [Best(top_k, x) for x in floors.value.tolist()]
            for doc_ids, docs, (tids, impacts) in segments(batches, 3, segment_postings):
                search_segment(doc_ids, docs, tids, impacts, n_terms, runs, terms, weights, best, ids if exclude_self else None)
            yield hits([(q, b) for q, b in zip(ids, best) if len(b.scores)], schema)

        # the index is sorted by document in its partitions and the join keeps that order, so this sort is dropped
        asked = (postings.select("term", "doc_id", "impact").join(F.broadcast(numbers), "term")
                 .select("doc_id", "tid", "impact").sortWithinPartitions("doc_id"))
        return asked.mapInArrow(task, schema)

    floors = np.full(len(ids), -np.inf)
    if seed_parts and len(ids) >= MANY_QUERIES:
        some = index.postings.where(F.pmod(F.hash("doc_id"), F.lit(index.n_parts)) < seed_parts)  # whole parts, by their own rule
        last = rank_top_k(search(some, floors), top_k).where(F.col("rank") == top_k).select("query_id", "score").toArrow()
        place = {q: i for i, q in enumerate(ids)}  # bounded: one block's queries
        floors[[place[q] for q in last.column(0).to_pylist()]] = last.column(1).to_numpy()
    return search(index.postings, floors)


def _blocked(qt: DataFrame, block_bytes: int) -> tuple[DataFrame, list[int]]:
    """Query terms with a ``block`` number, and the numbers in use; a block is at most ``block_bytes`` or one query."""
    size = F.lit(ROW_BYTES)
    total = qt.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(1.25 * total / block_bytes))
    while True:
        out = qt.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        sizes = (out.groupBy("block").agg(F.sum(size).alias("n"), (F.min("query_id") != F.max("query_id")).alias("several"))
                 .collect())  # bounded: one row per block
        if all(r["n"] <= block_bytes or not r["several"] for r in sizes):
            return out, sorted(r["block"] for r in sizes) or [0]
        blocks += math.ceil(blocks / 4)


def bm25_search(index: LexicalIndex, queries: DataFrame, top_k: int = C.TOP_K, query_id: str = "query_id",
                text: str = "text", exclude_self: bool = False, block_bytes: int = BLOCK_BYTES,
                storage: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Exact top-k BM25 run ``(query_id, doc_id, score, rank)``, written block by block to the shared folder."""
    qt = query_terms(queries, index, query_id, text).select("query_id", "term", "w").persist(storage)
    rows, blocks = _blocked(qt, block_bytes)
    path = scratch_path(qt.sparkSession, "bm25-run")
    for i in blocks:
        scored = block_hits(index, rows.where(F.col("block") == i).drop("block"), top_k, exclude_self, seed_parts=index.n_parts // SEED_PARTS)
        run = rank_top_k(scored, top_k).select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))
        run.write.mode("append").parquet(path)
    qt.unpersist()
    return qt.sparkSession.read.schema(run.schema).parquet(path)


def bm25_multisearch_docs(index: LexicalIndex, docs: DataFrame, top_hits: int = C.BM25_HARD_NEGATIVE_HITS,
                          doc_id: str = "doc_id", text_col: str = "full_text") -> DataFrame:
    """Batched multi-search with documents as queries: ``(query_id=doc id, doc_id, score, rank)``."""
    q = docs.select(F.col(doc_id).alias("query_id"), F.col(text_col).alias("text"))
    return bm25_search(index, q, top_k=top_hits)
