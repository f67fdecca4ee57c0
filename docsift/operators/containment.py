"""Exact substring-containment join without a cross join.

``contains_join(passages, docs)`` returns every (passage, document) pair where
the passage text occurs verbatim in the document text.

Plan: winnowing fingerprints (Schleimer et al., SIGMOD 2003).  Each document
keeps the minimum k-gram hash of every window of ``w`` consecutive k-grams; a
passage with at least ``w`` k-grams is represented by its single minimum k-gram
hash.  If the passage occurs in the document, the window of the document that
lies inside the passage and holds the passage minimum selects that hash, so an
equi-join on the hash finds every true pair; candidates are then verified with
a real substring test.  Shorter passages use smaller (k, w) levels down to
(1, 1), so the join is exact for any non-empty passage.

One plan at every size: fingerprints meet passage anchors in an equi-join on (hash, salt), where the salt is taken from
the document, so the documents of a hash that very many share (a boilerplate passage) lie in ``SALTS`` tasks or
more.  The candidate pairs are written, which tells Spark their size, and joined with the documents they name for
the substring test; Spark broadcasts whichever side of these joins is small by its own statistics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.session import spread, stored

#: (k, w) levels, largest first; a passage of length L uses the first level with L >= k + w - 1.
LEVELS = ((16, 48), (6, 10), (3, 1), (1, 1))
_BASE = np.uint64(1_000_003)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: hashes that a task collects before it hands them on
FINGERPRINT_ROWS = 1 << 16
#: parts that the documents of one hash are split into
SALTS = 16


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _kgram_hashes(text: str, k: int) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if cp.size < k:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h, width = cp, 1
        for bit in bin(k)[3:]:  # the hash of 2 * width characters from those of its halves
            h, width = h[:-width] * _power(width) + h[width:], 2 * width
            if bit == "1":
                h, width = h[:-1] * _BASE + cp[width:], width + 1
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` consecutive values in O(n) (van Herk / Gil-Werman)."""
    n = h.size
    m = -(-n // w) * w
    pad = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:n] = h
    blocks = pad.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1: n])


def winnow(text: str, k: int, w: int) -> np.ndarray:
    """Distinct winnowed hashes of ``text`` as int64."""
    h = _kgram_hashes(text or "", k)
    if h.size == 0:
        return np.empty(0, dtype=np.int64)
    if w > 1 and h.size > w:
        h = _window_min(h, w)
        h = h[np.append(True, h[1:] != h[:-1])]  # neighbouring windows mostly share their minimum
    elif w > 1:
        h = h[[int(np.argmin(h))]]
    return np.unique(h).view(np.int64)


def anchor(text: str, k: int) -> int | None:
    h = _kgram_hashes(text or "", k)
    if h.size == 0:
        return None
    return int(h.min().view(np.int64))


def level_of(length: int) -> int:
    for i, (k, w) in enumerate(LEVELS):
        if length >= k + w - 1:
            return i
    return -1


def _level_col(text_col: str):
    length = F.length(text_col)
    expr = F.lit(-1)
    for i in reversed(range(len(LEVELS))):
        k, w = LEVELS[i]
        expr = F.when(length >= k + w - 1, F.lit(i)).otherwise(expr)
    return expr


def fingerprint_batches(batches, k: int, w: int, limit: int = FINGERPRINT_ROWS):
    """(id, hash) rows of Arrow batches of (id, text): one text at a time is a Python string, and about ``limit`` hashes
    are held."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows, found, held = [], [], 0

        def cut():
            counts = [len(h) for h in found]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(rows, counts), pa.int64())),
                                               pa.array(np.concatenate(found), pa.int64())], names=["_did", "_h"])
        for i in range(batch.num_rows):
            h = winnow(texts[i].as_py(), k, w)
            if not len(h):
                continue
            rows.append(i)
            found.append(h)
            held += len(h)
            if held >= limit:
                yield cut()
                rows, found, held = [], [], 0
        if held:
            yield cut()


def fingerprints(docs: DataFrame, doc_id: str, doc_text: str, k: int, w: int) -> DataFrame:
    """(_did, _h): the winnowed hashes of every document, one row each."""
    schema = T.StructType([T.StructField("_did", docs.schema[doc_id].dataType), T.StructField("_h", T.LongType())])
    return (spread(docs).select(F.col(doc_id).alias("_did"), F.col(doc_text).alias("_dtext"))
            .mapInArrow(lambda batches: fingerprint_batches(batches, k, w), schema))


def _passage_table(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return (passages.select(F.col(id_col).alias("_pid"), F.col(text_col).alias("_ptext"))
            .where(F.col("_ptext").isNotNull() & (F.length("_ptext") > 0)))


def contains_join(passages: DataFrame, docs: DataFrame, passage_id: str = "item_id", passage_text: str = "text",
                  doc_id: str = "doc_id", doc_text: str = "text", doc_cols=()) -> DataFrame:
    """Pairs (passage_id, doc_id, *doc_cols) with ``contains(doc_text, passage_text)``.

    Empty/null passages are skipped (they would match every document).
    """
    spark = docs.sparkSession
    p = _passage_table(passages, passage_id, passage_text)
    levels_present = [r[0] for r in p.select(_level_col("_ptext").alias("lv")).distinct().collect()]  # bounded: len(LEVELS) rows

    @F.pandas_udf(T.LongType())
    def _anchor(texts: pd.Series, lvs: pd.Series) -> pd.Series:
        return pd.Series([anchor(t, LEVELS[lv][0]) for t, lv in zip(texts, lvs)], dtype="Int64")

    anchors = (p.withColumn("_lv", _level_col("_ptext")).withColumn("_h", _anchor("_ptext", "_lv"))
               .select("_pid", "_lv", "_h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")))
    cand = None
    for lv in levels_present:
        k, w = LEVELS[lv]
        fp = (fingerprints(docs, doc_id, doc_text, k, w)
              .withColumn("_s", F.pmod(F.xxhash64("_did"), F.lit(SALTS)).cast("int")))
        part = (anchors.where(F.col("_lv") == lv).select("_pid", "_h", "_s")
                .join(fp, ["_h", "_s"]).select("_pid", "_did").distinct())
        cand = part if cand is None else cand.unionByName(part)
    if cand is None:
        return spark.createDataFrame([], T.StructType([T.StructField("passage_id", passages.schema[passage_id].dataType),
                                                       T.StructField(doc_id, docs.schema[doc_id].dataType),
                                                       *[docs.schema[c] for c in doc_cols]]))
    found = stored(cand, "contain-pairs")
    pairs, named = found.join(p, "_pid"), found.select("_did").distinct()
    # the named documents alone move to their passages
    verified = (docs.select(F.col(doc_id).alias("_did"), F.col(doc_text).alias("_dtext"), *doc_cols)
                .join(named, "_did", "left_semi").join(pairs, "_did")
                .where(F.instr(F.col("_dtext"), F.col("_ptext")) > 0))
    return verified.select(F.col("_pid").alias("passage_id"), F.col("_did").alias(doc_id), *doc_cols).dropDuplicates(["passage_id", doc_id])
