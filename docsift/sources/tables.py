"""Table scans (#1), BEIR folders (#2), the triplet sink (#7) and index artefacts (#8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filter pushdown happen in Catalyst."""
    return spark.read.parquet(table_path(sf_dir, name))


def load_tables(spark: SparkSession, sf_dir: str, names=("documents", "benchmark", "embeddings")) -> dict:
    """``load_from_hf``/``get_data`` analogue: one lazily scanned DataFrame per table."""
    return {n: load_table(spark, sf_dir, n) for n in names}


# -- BEIR folder ------------------------------------------------------------

BEIR_CORPUS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("title", T.StringType()),
                            T.StructField("text", T.StringType())])
BEIR_QUERIES = T.StructType([T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())])
BEIR_QRELS = T.StructType([T.StructField("query-id", T.StringType()), T.StructField("corpus-id", T.StringType()),
                           T.StructField("score", T.IntegerType())])


def write_beir_folder(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str, split: str = "test") -> str:
    """Write corpus/queries as JSON lines and qrels as a tab-separated file with header."""
    (corpus.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("title", F.lit("")).alias("title"), "text")
     .write.mode("overwrite").json(f"{path}/corpus.jsonl"))
    (queries.select(F.col("query_id").cast("string").alias("_id"), "text")
     .write.mode("overwrite").json(f"{path}/queries.jsonl"))
    (qrels.select(F.col("query_id").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"),
                  F.col("relevance").cast("int").alias("score"))
     .write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/qrels/{split}.tsv"))
    return path


def load_beir_folder(spark: SparkSession, path: str, split: str = "test"):
    """Read ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/<split>.tsv`` into the canonical schemas."""
    corpus = (spark.read.schema(BEIR_CORPUS).json(f"{path}/corpus.jsonl")
              .select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text",
                      F.lit(None).cast("string").alias("language")))
    queries = (spark.read.schema(BEIR_QUERIES).json(f"{path}/queries.jsonl")
               .select(F.col("_id").alias("query_id"), "text", F.lit(None).cast("string").alias("language")))
    qrels = (spark.read.schema(BEIR_QRELS).option("sep", "\t").option("header", True).csv(f"{path}/qrels/{split}.tsv")
             .select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"),
                     F.lit(None).cast("string").alias("language"), F.col("score").alias("relevance")))
    return corpus, queries, qrels


# -- sinks ------------------------------------------------------------------

def write_triplets_json(triplets: DataFrame, path: str) -> str:
    """JSON-lines sink (sharded, one object per triplet)."""
    triplets.write.mode("overwrite").json(path)
    return path


def read_triplets_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the session (works for any FS scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def index_path(base: str, prefix: str, ext: str) -> str:
    return f"{base.rstrip('/')}/{prefix}.{ext}"


def save_or_load_index(spark: SparkSession, build, base: str, prefix: str, ext: str,
                       partition_by=None) -> DataFrame:
    """Load ``{base}/{prefix}.{ext}`` if present, else build it, write it, and read it back.

    ``build`` is a zero-argument callable returning the index DataFrame.  The
    written Parquet table is the artefact (no separate id map: ids are a column).
    """
    path = index_path(base, prefix, ext)
    if not path_exists(spark, f"{path}/_SUCCESS"):  # a folder without the mark is half written
        writer = build().write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.parquet(path)
