"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes each stage's rows as Parquet and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontam, line_dedup, lsh_forest, mixing, quality
from docsift.llm.common import documents, stored
from docsift.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier accepts.

    Null and empty texts are rejected; very long ones are scored whole; every row is judged for itself, so repeated
    rows and null ids stay or go alike; an empty table stays empty; all columns are kept.
    """
    _ready(spark)
    return quality.accepted(docs, quality.train(docs)[1])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines found in at least 10 of them; a document of such lines only stays, empty."""
    _ready(spark)
    return line_dedup.LineDedup(spark, min_docs=10).insert(docs).rewrite(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the smallest doc_id, a null one last.

    Texts are told apart even where they share a doc_id or have none; of rows equal in both one stays.  Null and
    empty texts link with nothing, so they stay (once for each doc_id); very long texts are compared whole; of ties the
    smaller doc_id stays; an empty table stays empty; other columns, of any name, are kept.
    """
    _ready(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column can clash with one made here
    plain = docs.toDF(*names)
    id_, text = (F.col(names[docs.columns.index(x)]) for x in ("doc_id", "text"))
    digest = F.coalesce(F.md5(text), F.lit(""))
    odd = plain.groupBy(id_.alias("doc_id")).count().where(F.col("doc_id").isNull() | (F.col("count") > 1))
    if odd.limit(1).count():  # doc_id does not name a row: one row a text and id, numbered in their order
        one = (plain.withColumn("digest", digest).groupBy(id_.alias("doc_id"), "digest")
               .agg(F.first(F.struct(*names)).alias("r")))
        rows = stored(one.orderBy(F.col("doc_id").asc_nulls_last(), "digest")
                      .select(F.monotonically_increasing_id().alias("row"), "r.*"), "near-rows")
        found = lsh_forest.near_duplicates(rows.select(F.col("row").alias("doc_id"), text.alias("text")))
        copies = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("row")).distinct(), "near-copies")
        return rows.join(copies, "row", "left_anti").select(*names).toDF(*docs.columns)
    found = lsh_forest.near_duplicates(plain.select(id_.alias("doc_id"), text.alias("text")))
    copies = stored(found.where(~F.col("kept")).select("doc_id").distinct(), "near-copies")
    return plain.join(copies, id_ == copies["doc_id"], "left_anti").toDF(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Decided by row: null and empty texts hold none and stay, very long ones are searched whole, repeated rows go
    together, an empty table (of documents or items) changes nothing, all columns are kept.
    """
    _ready(spark)
    return decontam.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: documents as often as their source's rate takes them, numbered by ``copy`` (see ``emit_mix``)."""
    _ready(spark)
    return mixing.emit_mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
]

#: The classifier, the forest's order and the filters have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    _ready(spark)
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
