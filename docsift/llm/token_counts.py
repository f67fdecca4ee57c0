"""Token counts through a digest cache.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens) in a shared folder.  Texts are
normalised (null to empty, runs of ``[\\x20\\x09-\\x0D]`` to one space, none at the ends, which the tokenizer drops
itself), digested and joined to the cache by content and tokenizer digest.  Of the digests without a count, one
row each is encoded and appended; then every row reads its count from the cache.

Encoding counts the space-separated pieces of a text: the tokenizer never joins text across white space, so a text
has as many tokens as its pieces, and a task encodes every distinct piece once while it remembers it.  For
tokenizers that keep white space (``pieces=False``) whole normalised texts are not equal to the raw ones, so
neither step applies: the raw text is digested and encoded as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sliced
from docsift.session import scratch_path

CACHE = "content binary, tokenizer binary, n_tokens long"
#: Distinct pieces a task remembers.
MEMO = 100_000


class Counter:
    """Token counts by the library of a tokenizer file; picklable by its bytes."""

    def __init__(self, path: str, pieces: bool | None = None):
        self.kind = os.path.splitext(path)[1]
        with open(path, "rb") as f:
            self.data = f.read()
        self.pieces = self._drops_white_space() if pieces is None else pieces
        self.digest = hashlib.sha256(self.kind.encode() + self.data).digest()
        self._encode, self.memo = None, {}

    def _drops_white_space(self) -> bool:
        """A split that keeps only matches without white space, and no special string that holds any."""
        if self.kind != ".json":
            return False
        spec = json.loads(self.data)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = next((s for s in steps if s["type"] == "Split"), None)
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        return bool(split and split.get("invert") and split["behavior"] == "Removed"
                    and "[^\\s" in split["pattern"].get("Regex", "") and not any(c.isspace() for s in specials for c in s)
                    and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])))

    def __getstate__(self):
        return self.__dict__ | {"_encode": None, "memo": {}}

    def _load(self):
        if self.kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            t = Tokenizer.from_str(self.data.decode())
            t.no_truncation()
            t.no_padding()
            return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self._encode is None:
            self._encode = self._load()
        if not self.pieces:
            return self._encode(texts)
        out = []
        for text in texts:
            parts = text.split(" ") if text else []
            if len(self.memo) > MEMO:
                self.memo.clear()
            new = list(set(parts).difference(self.memo))
            if new:
                self.memo.update(zip(new, self._encode(new)))
            out.append(sum(map(self.memo.__getitem__, parts)))
        return out

    def normalise(self, text: bytes) -> bytes:
        return b" ".join(text.split()) if self.pieces else text


def read_cache(spark, path: str) -> DataFrame:
    """The cache below ``path``; an empty one if nothing has been written yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def token_counts(docs: DataFrame, counter: Counter, cache_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text); the cache grows by the misses.

    Null texts count as empty.  Repeated and equal texts are encoded once; rows with a null doc_id are counted like
    any other.  An empty table gives no rows and leaves the cache as it is.  Other columns are ignored.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")

    def digests(batches):
        for batch in sliced(batches):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.blake2b(counter.normalise(t), digest_size=16).digest() for t in texts], pa.binary())],
                names=["doc_id", "n_bytes", "content"])

    path = scratch_path(spark, "token-digests")
    docs.select("doc_id", "text").mapInArrow(digests, "doc_id long, n_bytes long, content binary").write.parquet(path)
    rows = spark.read.schema("doc_id long, n_bytes long, content binary").parquet(path)

    def cached():
        return read_cache(spark, cache_path).where(F.col("tokenizer") == F.lit(bytearray(counter.digest)))

    misses = (rows.join(cached().select("content"), "content", "left_anti").groupBy("content")
              .agg(F.min("doc_id").alias("doc_id")))

    def encode(batches):
        for batch in sliced(batches):
            texts = [counter.normalise(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()]
            content = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(content, pa.binary()), pa.array([counter.digest] * len(texts), pa.binary()),
                pa.array(counter([t.decode() for t in texts]), pa.int64())], names=["content", "tokenizer", "n_tokens"])

    # the misses grow with the input: a merge join at every size, never a broadcast
    chosen = docs.select("doc_id", "text").join(misses.select(F.col("doc_id").alias("_one")).distinct().hint("merge"),
                                                F.col("doc_id").eqNullSafe(F.col("_one")), "left_semi")
    counts = chosen.select("text").mapInArrow(encode, CACHE)
    counts.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    have = cached().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(have, "content").select("doc_id", "n_bytes", "n_tokens")
