"""Benchmark decontamination in DataFrame operations only: short test items inside long documents.

Containment of an item in a document is |item & doc| / |item| over distinct five-word shingles.  Documents
are partitioned by size: a partition holds documents of up to u shingles (a power of two) and gives each
``BINS`` * u one-permutation MinHash bins, so a bin holds the least of at most 1 / ``BINS`` expected shingles
in every partition, and a shared shingle is in the document's sketch with the same probability at all sizes.
A document is a candidate for an item if its sketch holds one of the item's shingles; candidates are verified
on the full shingle sets.  Items of at most ``FEW`` shingles, for which a sketch could miss all shared ones, probe
all shingles instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import shingles, spaced_words, stored

THRESHOLD = 0.75
SHINGLE = 5
BINS = 2
FEW = 8
#: Item shingles are broadcast up to this many rows (about 24 bytes each), and shuffled beyond.
BROADCAST_ROWS = 1_000_000


def shingled(rows: DataFrame, *keep: str, n: int = SHINGLE) -> DataFrame:
    """Columns ``keep`` and ``shingles``, the sorted distinct shingle hashes of column ``text``."""
    return (rows.select(*keep, spaced_words(F.col("text")).alias("words"))
            .select(*keep, F.sort_array(shingles(F.col("words"), n)).alias("shingles")))


def sketch(sets: DataFrame, bins: int = BINS) -> DataFrame:
    """``shingles`` reduced to the least of every bin; the bin count follows the size partition.

    A bin is the hash's leading bits, so bins are runs of the sorted array.
    """
    bits = F.ceil(F.log2(F.greatest(F.size("shingles"), F.lit(1)) * F.lit(float(bins)))).cast("int")
    least = F.expr("filter(shingles, (x, i) -> i = 0 OR shiftrightunsigned(x, shift) <> "
                   "shiftrightunsigned(shingles[i - 1], shift))")
    return sets.withColumn("shift", F.lit(64) - F.greatest(bits, F.lit(1))).withColumn("shingles", least).drop("shift")


def leaked_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items at least ``threshold`` contained in a document.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.  Texts with fewer than
    ``n`` words are one shingle of all their words; such an item is looked for among the documents' shingles of its
    width.  Texts without words hold and match nothing.  Rows with one id
    are judged one by one, and equal results are given once.  Null ids are kept as such.  Empty tables give no rows.
    """
    return _leaks(docs, items, threshold, n).drop("doc").distinct()


def _leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """``leaked_items`` with ``doc``, the digest of the text that holds the item."""
    short = (items.select("item_id", spaced_words(F.col("text")).alias("words")).where(F.size("words").between(1, n - 1))
             .select("item_id", F.size("words").alias("width"), F.xxhash64("words").alias("h")).distinct())
    items = stored(shingled(items.select("item_id", "text").distinct(), "item_id", n=n)
                   .distinct()
                   .withColumn("item", F.xxhash64("item_id", "shingles")), "leak-items")
    probes = items.select("item", F.size("shingles").alias("n_item"), F.explode("shingles").alias("h"))
    n_probes = probes.count()
    few = probes.where(F.col("n_item") <= FEW).limit(1).count() > 0
    if n_probes <= BROADCAST_ROWS:
        probes = F.broadcast(probes)

    texts = docs.select("doc_id", "text")
    sets = shingled(texts.withColumn("doc", F.xxhash64("doc_id", "text")), "doc", n=n)
    # explode_outer: the filter that explode implies would be copied into the shingle lambdas
    marks = sketch(sets).select("doc", F.explode_outer("shingles").alias("h"))
    pairs = marks.join(probes, "h").where(F.col("n_item") > FEW).select("doc", "item")
    if few:
        pairs = pairs.unionByName(sets.select("doc", F.explode_outer("shingles").alias("h")).join(probes, "h")
                                  .where(F.col("n_item") <= FEW).select("doc", "item"))
    pairs = stored(pairs.distinct(), "leak-pairs")

    found = texts.withColumn("doc", F.xxhash64("doc_id", "text")).join(pairs.select("doc").distinct(), "doc", "left_semi")
    full = shingled(found.withColumn("digest", F.md5("text")), "doc", "digest", "doc_id", n=n)
    shared = F.size(F.array_intersect("shingles", "item_shingles"))
    leaks = (pairs.join(items.withColumnRenamed("shingles", "item_shingles"), "item").join(full, "doc")
            .select(F.col("digest").alias("doc"), "doc_id", "item_id", shared.cast("long").alias("n_shared"),
                    F.size("item_shingles").cast("long").alias("n_item"))
            .withColumn("containment", F.col("n_shared") / F.col("n_item"))
            .where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold)))

    widths = sorted(r["width"] for r in short.select("width").distinct().toLocalIterator())  # bounded: below n
    if widths:
        short = stored(short, "leak-short")
        if short.count() <= BROADCAST_ROWS:
            short = F.broadcast(short)

        def marked(w):
            return F.transform(shingles(F.col("words"), w), lambda h: F.struct(F.lit(w).alias("width"), h.alias("h")))

        held = (texts.select("doc_id", F.md5("text").alias("doc"), spaced_words(F.col("text")).alias("words"))
                .select("doc_id", "doc", F.explode_outer(F.concat(*map(marked, widths))).alias("m"))
                .select("doc_id", "doc", "m.width", "m.h").join(short, ["width", "h"]))
        one = F.lit(1).cast("long")
        leaks = leaks.unionByName(held.select("doc", "doc_id", "item_id", one.alias("n_shared"), one.alias("n_item"),
                                              F.lit(1.0).alias("containment")))
    return leaks


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept; decided by each row's text, whatever its doc_id."""
    leaked = _leaks(docs, items, **options).select(F.col("doc").alias("_leaked")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column can clash with one made here
    text = F.col(names[docs.columns.index("text")])
    return docs.toDF(*names).join(leaked, F.md5(text) == F.col("_leaked"), "left_anti").toDF(*docs.columns)
