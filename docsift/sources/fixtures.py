"""Retrieval fixtures derived from the driver tables (whole tables, no id subsets).

FX-1  passage -> document: queries = ``benchmark`` passages, qrels = documents
      that contain the passage verbatim (exact containment join, no cross join).
FX-2  document -> document: every document is a query (full text), qrels link
      documents of the same ``source`` whose ids are at most 60 apart (a bounded
      band join on id buckets); qrels.language is the shared language or 'mixed'.
FX-3  vectors: every embedding queries the whole embedding table (self hits are
      excluded at search time); qrels = same ``label`` and ids at most 50 apart.

All builders return canonical relations: corpus(doc_id, title, text, language),
queries(query_id, text, language), qrels(query_id, doc_id, language, relevance).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators.containment import contains_join
from docsift.sources.tables import load_table

FX2_BAND = 60
FX3_BAND = 50


@dataclass
class Dataset:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lit("").alias("title"), "text", F.col("lang").alias("language"))


def band_pairs(left: DataFrame, right: DataFrame, id_l: str, id_r: str, band: int, extra_keys=()) -> DataFrame:
    """Equi-join on id buckets of width ``band`` (+ extra keys), then ``|l - r| <= band``.

    Each bucket holds at most ``band`` distinct ids per key, so no group can
    explode; the left side is replicated to its 3 neighbouring buckets.
    Column names other than ``extra_keys`` must differ between the sides.
    """
    lb = left.withColumn("_b", F.explode(F.array(*[F.floor(F.col(id_l) / band) + d for d in (-1, 0, 1)]))).alias("l")
    rb = right.withColumn("_b", F.floor(F.col(id_r) / band)).alias("r")
    cond = [F.col("l._b") == F.col("r._b")] + [F.col(f"l.{k}") == F.col(f"r.{k}") for k in extra_keys]
    keep = [F.col(f"l.{c}") for c in left.columns] + [F.col(f"r.{c}") for c in right.columns if c not in extra_keys]
    return (lb.join(rb, cond)
            .where((F.abs(F.col(f"l.{id_l}") - F.col(f"r.{id_r}")) <= band) & (F.col(f"l.{id_l}") != F.col(f"r.{id_r}")))
            .select(*keep))


def fx1(spark: SparkSession, sf_dir: str) -> Dataset:
    documents = load_table(spark, sf_dir, "documents")
    benchmark = load_table(spark, sf_dir, "benchmark")
    corpus = corpus_from_documents(documents)
    pairs = contains_join(benchmark, documents, passage_id="item_id", passage_text="text",
                          doc_id="doc_id", doc_text="text", doc_cols=("lang",))
    qrels = pairs.select(F.col("passage_id").alias("query_id"), "doc_id", F.col("lang").alias("language"),
                         F.lit(1).alias("relevance"))
    qlang = qrels.groupBy("query_id").agg(
        F.when(F.min("language") == F.max("language"), F.min("language")).otherwise(F.lit("mixed")).alias("language"))
    queries = (benchmark.select(F.col("item_id").alias("query_id"), "text")
               .join(qlang, "query_id", "left")
               .select("query_id", "text", F.coalesce("language", F.lit("mixed")).alias("language")))
    return Dataset(corpus, queries, qrels)


def fx2(spark: SparkSession, sf_dir: str) -> Dataset:
    documents = load_table(spark, sf_dir, "documents")
    corpus = corpus_from_documents(documents)
    queries = documents.select(F.col("doc_id").alias("query_id"), "text", F.col("lang").alias("language"))
    left = documents.select(F.col("doc_id").alias("query_id"), F.col("source"), F.col("lang").alias("qlang"))
    right = documents.select("doc_id", F.col("source").alias("source"), F.col("lang").alias("dlang"))
    pairs = band_pairs(left, right, "query_id", "doc_id", FX2_BAND, extra_keys=("source",))
    qrels = pairs.select("query_id", "doc_id",
                         F.when(F.col("qlang") == F.col("dlang"), F.col("qlang")).otherwise(F.lit("mixed")).alias("language"),
                         F.lit(1).alias("relevance"))
    return Dataset(corpus, queries, qrels)


def fx3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def fx3_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = load_table(spark, sf_dir, "embeddings")
    left = emb.select(F.col("vec_id").alias("query_id"), "label")
    right = emb.select(F.col("vec_id").alias("doc_id"), "label")
    pairs = band_pairs(left, right, "query_id", "doc_id", FX3_BAND, extra_keys=("label",))
    return pairs.select("query_id", "doc_id", F.lit(None).cast("string").alias("language"), F.lit(1).alias("relevance"))
