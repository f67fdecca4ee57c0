"""Ranked lexical search by the Best Position Algorithm over impact lists.

Every query term has an impact list in a shard of documents: its postings by falling impact.  All lists of a query
are read from the top together.  A document met in one list is looked up in all others at once (direct access), which
gives its whole score and marks its place in every list.  A list's best position is the end of the contiguous run of
seen places; the impacts just beyond the best positions, summed, bound every unseen document, and lie below the
impacts last read, since direct accesses push best positions ahead.  Reading stops when this bound falls strictly below the
k-th best score (an equal score could still win by its smaller doc_id).

* One pass over the texts keeps each document's length and its counts of the asked terms only, written as a table;
  document frequencies, N and L come from that table.
* A task holds one shard of at most ``SHARD_POSTINGS`` postings (or one document) at a time and carries each query's
  best rows from shard to shard, so later shards start with a higher k-th score.  A bounded first table gives every
  task a starting k-th score; any value gives the same result.
* Queries go in blocks of at most ``BLOCK_TERMS`` (item, term) rows, or one item; a block is broadcast and served by
  passes of its own.  A final rank merges the tasks' rows.

Scores are exact 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import LOWER, UPPER, sliced, stored
from docsift.session import scratch_path

TOP = 10
#: (item, term) rows of a broadcast block, postings of a shard, documents of the first table, rows first read of a list.
BLOCK_TERMS, SHARD_POSTINGS, SEED_DOCS, FIRST_ROWS = 200_000, 1_000_000, 4096, 16

#: ASCII letters lower-cased; every other ASCII code but the digits separates terms.
_FOLD = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(
    bytes.maketrans(UPPER.encode(), LOWER.encode()))
COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
HITS = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct terms of each item."""
    def task(batches):
        for batch in sliced(batches):
            found = [(i, t.decode()) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for t in set(terms_of(x))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()),
                                              pa.array([f[1] for f in found], pa.string())], names=["item_id", "term"])
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(task, "item_id long, term string").distinct()


def _blocks(terms: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """``terms`` with a ``block`` column, and the blocks in use: at most ``limit`` rows or a single item each."""
    n = max(1, -(-terms.count() // limit))
    while True:
        out = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
        sizes = (out.groupBy("block").agg(F.count(F.lit(1)).alias("n"), (F.min("item_id") != F.max("item_id")).alias("several"))
                 .collect())  # bounded: one row a block
        if all(r["n"] <= limit or not r["several"] for r in sizes):
            return out, sorted(r["block"] for r in sizes)
        n *= 2


def _count_task(shared):
    """Documents as (doc_id, n, terms, tfs): number of terms in all, and the asked terms with their counts."""
    def task(batches):
        number = shared.value.get
        for batch in sliced(batches):
            length, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                found = terms_of(text)
                counts = Counter(map(number, found))
                counts.pop(None, None)
                length.append(len(found))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(length, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])
    return task


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Impact lists of the asked terms over some documents, and direct access to a document's places in them."""

    def __init__(self, doc_ids, lengths, sizes, terms, tfs, weights, n_docs, n_terms):
        self.ids = doc_ids
        m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
        owner = np.repeat(np.arange(len(doc_ids)), sizes)
        self.term = terms
        self.impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
        self.first = np.append(0, np.cumsum(sizes))  # a document's postings
        order = np.lexsort((-self.impact, terms))
        self.place = np.empty(len(order), np.int64)  # of a posting in the lists
        self.place[order] = np.arange(len(order))
        self.listed, self.falling = owner[order], self.impact[order]
        self.start = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.seen = np.zeros(len(order), bool)
        self.met = np.zeros(len(doc_ids), bool)
        self.asked = np.zeros(len(weights), bool)
        self.read = 0  # rows read from lists, for tests

    def best(self, query: np.ndarray, floor: int, k: int, first_rows: int = FIRST_ROWS):
        """(scores, doc ids) of at most ``k`` documents; those of at least ``floor`` (1 or more) are complete."""
        lists = [(int(a), int(b)) for a, b in zip(self.start[query], self.start[query + 1]) if b > a]
        self.asked[query] = True
        at, step, touched, met = [a for a, _ in lists], first_rows, [], []
        scores, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        while True:
            bound = sum(int(self.falling[p]) for p, (_, b) in zip(at, lists) if p < b)
            if bound < floor:
                break
            docs = np.concatenate([self.listed[p:min(p + step, b)] for p, (_, b) in zip(at, lists) if p < b])
            self.read += len(docs)
            docs = np.unique(docs[~self.met[docs]])
            if len(docs):
                self.met[docs] = True
                met.append(docs)
                counts = self.first[docs + 1] - self.first[docs]
                ends = np.cumsum(counts)
                postings = np.arange(ends[-1]) + np.repeat(self.first[docs] - (ends - counts), counts)
                mine = self.asked[self.term[postings]]
                score = np.add.reduceat(np.where(mine, self.impact[postings], 0), ends - counts)
                places = self.place[postings[mine]]
                self.seen[places] = True
                touched.append(places)
                good = score >= floor
                scores, ids = np.append(scores, score[good]), np.append(ids, self.ids[docs[good]])
                if len(scores) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                if len(scores) == k:
                    floor = max(floor, int(scores.min()))
            for i, (_, b) in enumerate(lists):
                p = at[i]
                while p < b and self.seen[p]:  # to the end of the contiguous run of seen places
                    run = self.seen[p:p + step]
                    p += len(run) if run.all() else int(run.argmin())
                at[i] = min(p, b)
            step = min(2 * step, 4096)
        for x in touched:
            self.seen[x] = False
        for x in met:
            self.met[x] = False
        self.asked[query] = False
        return scores, ids


def _shards(batches, limit):
    """Runs of (doc_ids, n, sizes, terms, tfs) arrays with at most about ``limit`` postings."""
    parts, size = [], 0
    for batch in sliced(batches, 1024):
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        parts.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), sizes,
                      batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()))
        size += int(sizes.sum())
        if size >= limit:
            yield [np.concatenate(x) for x in zip(*parts)]
            parts, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*parts)]


def _search_task(shared, k, limit):
    def task(batches):
        items, queries, floors, weights, n_docs, n_terms = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        floors = floors.copy()
        for arrays in _shards(batches, limit):
            shard = Shard(*arrays, weights, n_docs, n_terms)
            for i, query in enumerate(queries):
                scores, ids = shard.best(query, int(floors[i]), k)
                if len(scores):
                    scores, ids = np.append(best[i][0], scores), np.append(best[i][1], ids)
                    top = np.lexsort((ids, -scores))[:k]
                    best[i] = scores[top], ids[top]
                    if len(top) == k:
                        floors[i] = max(floors[i], int(best[i][0].min()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(items, [len(s) for s, _ in best]), pa.int64()),
             pa.array(np.concatenate([x for _, x in best] + [np.empty(0, np.int64)]), pa.int64()),
             pa.array(np.concatenate([s for s, _ in best] + [np.empty(0, np.int64)]), pa.int64())],
            names=["item_id", "doc_id", "score"])
    return task


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS,
                  shard_postings: int = SHARD_POSTINGS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    ``docs`` is (doc_id, text), ``items`` (item_id, text).  A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a
    document's length term m is 10 + 90 n N div L, and its score sums weight * (10^9 tf div (1000 tf + 8 m)) over the
    item's distinct terms; equal scores go by ascending doc_id.  Null and empty texts have no terms; an item without
    terms finds nothing; rows with one item_id are one item with the terms of all; items without an id take no part.
    Documents without an id count in the statistics and are not ranked; repeated doc_ids are documents of their own.
    Texts of any length are counted whole.  Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    terms, blocks = _blocks(stored(item_terms(items), "bpa-terms"), block_terms)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scratch_path(spark, "bpa-out")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    schema = "item_id long, rank int, doc_id long, score long"
    for block in blocks:
        asked = terms.where(F.col("block") == block).select("item_id", "term").toArrow()  # bounded: one block
        names = asked.column(1).unique().to_pylist()
        number = {t.encode(): i for i, t in enumerate(names)}
        words = spark.sparkContext.broadcast(number)
        counted = stored(texts.mapInArrow(_count_task(words), COUNTED), "bpa-counts")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(len(names), np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # bounded: terms of one block
            df[r["t"]] = r["count"]
        if not n_terms:
            break
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        ids = np.array(asked.column(0).to_pylist(), np.int64)
        term = np.array([number[t.encode()] for t in asked.column(1).to_pylist()], np.int64)
        by = np.lexsort((term, ids))
        item_ids, starts = np.unique(ids[by], return_index=True)
        queries = np.split(term[by], starts[1:])
        counted = counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))

        def search(rows, floors):
            shared = spark.sparkContext.broadcast((item_ids, queries, floors, weights, n_docs, n_terms))
            found = rows.mapInArrow(_search_task(shared, k, shard_postings), HITS).withColumn("rank", F.row_number().over(order))
            return shared, found

        floors = np.ones(len(item_ids), np.int64)  # scores above 0
        shared, found = search(stored(counted.limit(seed_docs), "bpa-seed"), floors)
        first = found.where(F.col("rank") == k).select("item_id", "score").toArrow()  # bounded: one score an item of the block
        shared.destroy()
        at = np.searchsorted(item_ids, first.column(0).to_numpy())
        floors[at] = np.maximum(floors[at], first.column(1).to_numpy())
        shared, found = search(counted, floors)
        found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
        shared.destroy()
        words.destroy()
    else:
        if blocks:
            return spark.read.schema(schema).parquet(out)
    return spark.createDataFrame([], schema)
