"""Exact top-k inner-product search by MaxScore.

Every vector component is a posting (term = position, weight = component).  A task holds one shard
of the postings at a time, term by term.  For a query, terms are ranked by the largest amount they
can add; the tail whose summed bounds stay below the current k-th score is non-essential.  Essential
postings are traversed for the whole shard, then the non-essential lists are probed in falling bound
order, only for rows that can still reach the k-th score.  Tasks keep one running top-k per query and
emit it once, at their end; a final rank merges the shards.

Queries are served in blocks of a documented size: a block is broadcast (``query_block`` rows), and
one pass over the vectors serves it, so memory does not grow with the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import stored
from docsift.session import scratch_path

#: Queries per broadcast block and rows per posting shard inside a task.
QUERY_BLOCK = 16384
SHARD_ROWS = 8192
#: Rows scored first to give every query a starting k-th score (any value gives the same result).
SEED_ROWS = 4096

SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and every component present and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix; missing trailing terms weigh 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    if matrix.shape[1] >= width:
        return matrix[:, :width]
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


class TopK:
    """Running best rows of every query over the shards of one task."""

    def __init__(self, query_ids, queries, floor, k):
        self.ids, self.q, self.floor, self.k = query_ids, queries, floor, k
        self.best = [(np.empty(0), np.empty(0, np.int64)) for _ in query_ids]

    def add(self, row_ids: np.ndarray, rows: np.ndarray) -> None:
        lists = np.ascontiguousarray(_fit(rows, self.q.shape[1]).T)
        if not lists.shape[1]:
            return
        low, high = lists.min(axis=1), lists.max(axis=1)
        for i, q in enumerate(self.q):
            scores, ids = self.best[i]
            at = max(self.floor[i], scores[-1]) if len(scores) == self.k else self.floor[i]
            found, score = self._search(q, lists, np.maximum(q * low, q * high), np.minimum(q * low, q * high), at)
            own = row_ids[found] != self.ids[i]
            if own.any():
                scores = np.concatenate([scores, score[own]])
                ids = np.concatenate([ids, row_ids[found][own]])
                order = np.lexsort((ids, -scores))[: self.k]
                self.best[i] = (scores[order], ids[order])

    @staticmethod
    def _search(q, lists, most, least, at):
        """Rows of the shard whose score reaches ``at`` (all if it is -inf), with their scores."""
        order = np.argsort(least - most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # bound of the terms from a rank on
        floor = np.concatenate([[0.0], np.cumsum(least[order])])
        # a row that adds no more than the least amount in the first e lists cannot reach ``at`` by the others
        essential = min(int(np.searchsorted(-(floor + rest), -at, side="right")), len(order))
        terms = order[:essential]
        partial = q @ lists if essential == len(order) else q[terms] @ lists[terms]  # the essential lists alone
        found = np.flatnonzero(partial + rest[essential] >= at)
        partial = partial[found]
        for rank in range(essential, len(order)):
            if not len(found):
                break
            term = order[rank]
            partial = partial + q[term] * lists[term, found]
            keep = partial + rest[rank + 1] >= at
            if not keep.all():
                found, partial = found[keep], partial[keep]
        return found, partial

    def rows(self):
        n = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(self.ids, n), pa.int64()),
            pa.array(np.concatenate([x for _, x in self.best] + [np.empty(0, np.int64)]), pa.int64()),
            pa.array(np.concatenate([s for s, _ in self.best] + [np.empty(0)]).astype(np.int64), pa.int64())],
            names=["query_id", "vec_id", "score"])


def _search_task(shared, k: int):
    def run(batches):
        ids, queries, floor = shared.value
        top = TopK(ids, queries, floor, k)
        for batch in batches:
            row_ids = batch.column(0).to_numpy(zero_copy_only=False)
            rows = _matrix(batch.column(1))
            for start in range(0, len(row_ids), SHARD_ROWS):
                top.add(row_ids[start:start + SHARD_ROWS], rows[start:start + SHARD_ROWS])
        yield top.rows()
    return run


def topk_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK,
                       seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products.

    Both sides are (vec_id long, weights array<long>); weights are exact integers and scores stay below 2^53.
    A row with the query's own id is no candidate.  Ties go to the smaller vec_id; fewer candidates than
    ``k`` give fewer rows; repeated candidate rows each count; of repeated query ids the smallest vector asks.
    Rows with a null id or vector take no part, missing trailing terms weigh 0, empty input gives no rows.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "weights").where(F.col("vec_id").isNotNull() & F.col("weights").isNotNull())
    asked = (queries.where(F.col("vec_id").isNotNull() & F.col("weights").isNotNull())
             .groupBy("vec_id").agg(F.min("weights").alias("weights")))
    n = asked.count()
    blocks = max(1, -(-n // query_block))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "maxscore-q")
    seeds = stored(vectors.limit(seed_rows), "maxscore-seed")
    out = scratch_path(spark, "maxscore-out")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for block in range(blocks):
        table = asked.where(F.col("block") == block).select("vec_id", "weights").toArrow()  # bounded: one query block
        ids = table.column(0).to_numpy()
        q = _matrix(table.column(1))
        floor = np.full(len(ids), -np.inf)
        shared = spark.sparkContext.broadcast((ids, q, floor))
        first = (seeds.mapInArrow(_search_task(shared, k), SCHEMA)
                 .withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
                 .select("query_id", "score").toArrow())  # bounded: one score for each query of the block
        at = dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist()))
        floor = np.array([at.get(i, -np.inf) for i in ids.tolist()], float)
        shared = spark.sparkContext.broadcast((ids, q, floor))
        (vectors.mapInArrow(_search_task(shared, k), SCHEMA)
         .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out))
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)
