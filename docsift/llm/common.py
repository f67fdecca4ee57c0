"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import scratch_path

#: Whitespace of the text contracts, as a character class body, and a word of it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Spark's own setting: remove an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage with a durable, compressed copy that survives lost executors.  The shuffle files of the write
    are not needed after it and are removed, so that many rounds do not fill the executors' disks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches, rows: int = 512):
    """Arrow batches cut into short ones, so that a task's Python objects stay small beside the batch itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spaced_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; null and blank give no words.

    Only ASCII letters change case.  Splitting at whitespace runs leaves empty strings at both
    ends of the array unless the text is trimmed first.
    """
    t = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"[{SPACE}]+"))


def shingles(words: Column, n: int = 5) -> Column:
    """Distinct 64-bit hashes of the ``n``-word shingles; fewer words make one shingle, none make none.

    ``words`` must be a column of its own (not an expression), since the lambda reads it for every shingle.
    """
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - n),
                         lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))
    return (F.when(F.size(words) >= n, F.array_distinct(hashed))
            .when(F.size(words) > 0, F.array(F.xxhash64(words)))
            .otherwise(F.array().cast("array<bigint>")))
