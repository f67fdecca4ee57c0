"""Stored lexical index (#8, #40): published versions, deletes and appends, reads pruned by term.

A store is a folder on the shared file system:

* ``seg-<id>/postings/part=<n>``  (term, doc_id, tf, dl), range-partitioned and sorted by term and document, so the
                                  postings of a frequent term lie in several parts;
* ``seg-<id>/parts``              the least and largest term of each part;
* ``seg-<id>/terms``              (term, df), in the segment's own documents;
* ``seg-<id>/docs``               (doc_id, tokens) of these documents;
* ``seg-<id>/deleted``            ids that the segment takes out of earlier segments;
* ``versions/v=<number>``         one row: the segments in order, N and the number of tokens.  It is written last,
  so a version is either whole or not there; readers take the newest whole one.

``append`` and ``delete`` write one segment with its own documents and the changes of N, tokens and df (a deleted
document's postings count against them), and publish a new version.  ``read`` merges: a posting lives unless a later
segment deletes its document; df, N and avgdl are sums of the deltas.  Parts whose range holds none of the asked
terms are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators import lexical as L
from docsift.sources.tables import path_exists

VERSION = "segments array<string>, n_docs long, tokens long, analyzer string"

#: text of a partition while a segment is counted; nothing is searched there, so it is small and its counts stay in cache
SEGMENT_BYTES = 4 << 20


class IncompleteIndex(RuntimeError):
    """The folder holds no published version."""


class LexicalStore:
    def __init__(self, spark: SparkSession, path: str, k1: float = C.BM25_K1, b: float = C.BM25_B):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b

    # -- versions -------------------------------------------------------------

    def _numbers(self) -> list[int]:
        """Numbers of the whole versions, in order."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = sorted(int(n[2:]) for n in names if n.startswith("v="))
        return [n for n in found if path_exists(self.spark, f"{self.path}/versions/v={n}/_SUCCESS")]

    def version(self):
        """The newest whole version's row."""
        numbers = self._numbers()
        if not numbers:
            raise IncompleteIndex(f"{self.path} holds no published index")
        return self.spark.read.schema(VERSION).json(f"{self.path}/versions/v={numbers[-1]}").first()  # one row

    def exists(self) -> bool:
        return bool(self._numbers())

    def _publish(self, segments: list[str], n_docs: int, tokens: int, analyzer: str | None) -> None:
        number = (self._numbers() or [0])[-1] + 1
        row = self.spark.createDataFrame([(segments, n_docs, tokens, analyzer)], VERSION)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/v={number}")

    # -- writing --------------------------------------------------------------

    def _segment(self, docs: DataFrame, analyzer: str | None, deleted: DataFrame | None) -> tuple[str, int, int]:
        """Write one segment; its name, documents and tokens."""
        name = f"seg-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{name}"
        index = L.bm25_index(docs, analyzer=analyzer, partition_bytes=SEGMENT_BYTES)
        n_docs, tokens = index.n_docs, round(index.avgdl * index.n_docs)
        # the part leads the sort, so writing by part needs no second one
        (index.postings.select("term", "doc_id", "tf", "dl")
         .repartitionByRange(L.partitions_for(docs, tokens, L.PARTITION_TOKENS), "term", "doc_id")
         .withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "term", "doc_id")
         .write.partitionBy("part").parquet(f"{at}/postings"))
        index.postings.groupBy("doc_id").agg(F.sum("tf").alias("tokens")).write.parquet(f"{at}/docs")
        index.unpersist()
        if path_exists(self.spark, f"{at}/postings/_SUCCESS") and n_docs:
            # frequencies first: the bounds then come from a row for each term and part, and one scan of the terms serves both
            counts = (self.spark.read.parquet(f"{at}/postings").groupBy("part", "term").agg(F.count(F.lit(1)).alias("df"))
                      .persist(StorageLevel.MEMORY_AND_DISK))
        else:
            counts = self.spark.createDataFrame([], "part int, term string, df long")
        counts.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{at}/terms")
        (counts.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last"))
         .coalesce(1).write.parquet(f"{at}/parts"))
        counts.unpersist()
        if deleted is None:
            deleted = docs.select("doc_id").limit(0)
        deleted.select("doc_id").distinct().write.parquet(f"{at}/deleted")
        return name, n_docs, tokens

    def create(self, docs: DataFrame, analyzer: str | None = None) -> "LexicalStore":
        """Publish an index of ``docs`` (doc_id, text) alone, whatever was there before."""
        name, n_docs, tokens = self._segment(docs, analyzer, None)
        self._publish([name], n_docs, tokens, analyzer)
        return self

    def append(self, docs: DataFrame) -> "LexicalStore":
        """Add documents; ones that are there already are replaced."""
        return self._change(docs, docs.select("doc_id"))

    def delete(self, ids: DataFrame) -> "LexicalStore":
        """Take documents (doc_id) out; unknown ids change nothing."""
        empty = self.spark.createDataFrame([], "doc_id long, text string").select(
            F.col("doc_id").cast(ids.schema["doc_id"].dataType).alias("doc_id"), "text")
        return self._change(empty, ids.select("doc_id"))

    def _change(self, docs: DataFrame, out: DataFrame) -> "LexicalStore":
        v = self.version()
        gone = (self._docs(list(v["segments"])).join(out.distinct(), "doc_id", "left_semi")
                .groupBy("doc_id").agg(F.sum("tokens").alias("tokens")).persist())
        less = gone.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
        name, n_docs, tokens = self._segment(docs, v["analyzer"], gone)
        gone.unpersist()
        self._publish([*v["segments"], name], v["n_docs"] - less["n"] + n_docs, v["tokens"] - less["t"] + tokens, v["analyzer"])
        return self

    # -- reading --------------------------------------------------------------

    def _living(self, rows: DataFrame, later: list[str]) -> DataFrame:
        """``rows`` of a segment without the documents that the ``later`` segments delete."""
        for name in later:
            rows = rows.join(self.spark.read.parquet(f"{self.path}/{name}/deleted"), "doc_id", "left_anti")
        return rows

    def _docs(self, segments: list[str]) -> DataFrame:
        """Living documents (doc_id, tokens)."""
        return reduce(DataFrame.unionByName, [self._living(self.spark.read.parquet(f"{self.path}/{name}/docs"), segments[i + 1:])
                                              for i, name in enumerate(segments)])

    def _postings(self, segments: list[str], terms: DataFrame | None = None) -> DataFrame:
        """Living postings (term, doc_id, tf, dl); with ``terms`` only parts that may hold one of them are read."""
        out = None
        for i, name in enumerate(segments):
            at = f"{self.path}/{name}"
            ranges = self.spark.read.schema("part int, first string, last string").parquet(f"{at}/parts")
            if terms is None:
                found = ranges.select("part")
            else:
                found = (terms.select("term").join(F.broadcast(ranges), (F.col("term") >= F.col("first")) & (F.col("term") <= F.col("last")))
                         .select("part").distinct())
            parts = sorted(r["part"] for r in found.collect())  # bounded: the parts of a segment
            if not parts:
                continue
            rows = self.spark.read.parquet(f"{at}/postings").where(F.col("part").isin(parts)).select("term", "doc_id", "tf", "dl")
            rows = self._living(rows, segments[i + 1:])
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.read.parquet(f"{self.path}/{segments[0]}/deleted").limit(0).select(
                F.lit("").alias("term"), "doc_id", F.lit(0).cast("long").alias("tf"), F.lit(0).alias("dl"))
        return out if terms is None else out.join(terms.select("term").distinct(), "term", "left_semi")

    def read(self, queries: DataFrame | None = None, query_id: str = "query_id", text: str = "text",
             storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK) -> L.LexicalIndex:
        """The newest version as an index; with ``queries`` only the postings of their terms, scored as in the whole.

        ``storage`` None: nothing is persisted, for callers that go through the postings once.
        """
        v = self.version()
        n_docs, avgdl = v["n_docs"], v["tokens"] / v["n_docs"] if v["n_docs"] else 0.0
        terms = None
        if queries is not None:
            rows = queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("_text"))
            terms = (rows.select(F.explode_outer(L.term_array(F.col("_text"), v["analyzer"])).alias("term"))
                     .where(F.col("term").isNotNull()).distinct().persist())
        living = self._postings(list(v["segments"]), terms)
        norm = F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(avgdl or 1.0))
        postings = (living.repartition(L.partitions_for(living, v["tokens"], L.PARTITION_TOKENS), "doc_id").sortWithinPartitions("doc_id")
                    .select("term", "doc_id", "tf", "dl", (F.col("tf") * F.lit(self.k1 + 1.0) / (F.col("tf") + norm)).alias("impact")))
        if len(v["segments"]) == 1:  # nothing deleted: the stored frequencies hold
            df = self.spark.read.schema("term string, df long").parquet(f"{self.path}/{v['segments'][0]}/terms")
            df = df if terms is None else df.join(terms, "term", "left_semi")
        else:
            df = living.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = df.withColumn("idf", F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))))
        held = [] if storage is None else [postings.persist(storage), df.persist(storage)]
        return L.LexicalIndex(postings, df, n_docs, avgdl, self.k1, self.b, v["analyzer"], held + ([terms] if terms is not None else []))


def open_or_create(spark: SparkSession, path: str, docs, analyzer: str | None = None) -> tuple[LexicalStore, bool]:
    """(store, loaded): the published index at ``path`` if there is one (``docs`` is not touched), else a new one.

    ``docs`` is a zero-argument callable.  A folder without a published version (a writer that died) is built anew.
    """
    store = LexicalStore(spark, path)
    if store.exists():
        return store, True
    return store.create(docs(), analyzer), False
