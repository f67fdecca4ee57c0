"""Line dedup with sharded cuckoo filters over exact reference counts.

State (two Parquet tables below one path):

* ``counts``  (key binary, n long): in how many documents each line key occurs; exact.
* ``filters`` (shard int, table binary): per key shard a cuckoo filter of the keys that reached the
  threshold.  Cuckoo filters support deletion, so deleting documents takes their keys out again.

``insert`` and ``delete`` merge a batch's counts (plus or minus) into the reference counts, and add or
remove exactly those keys that crossed the threshold in their shard's filter.  ``apply`` drops lines
in one map-side pass over the texts: a line goes if its key is in the filter and not among the filter's
false positives, which are found once by probing every key below the threshold.  Filter plus exceptions
are exact for every counted key.  They are broadcast only while their size stays below ``BROADCAST_MB``;
beyond it the lines join the reference counts, with the same result.

A line's key is the UTF-8 line, stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased, as a 128-bit digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sliced
from docsift.session import scratch_path

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 500
#: Keys per filter shard at most when filters are built, and the bound for broadcasting all of them.
SHARD_KEYS = 50_000
BROADCAST_MB = 64

RESULT = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """Digest of the line's key, or None for keys of fewer than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()  # bytes.lower() changes ASCII letters only
    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(batch, i: int) -> list[bytes]:
    column = batch.column(i)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# -- cuckoo filter ------------------------------------------------------------

def _places(keys: np.ndarray, n_buckets: int):
    """Fingerprint and both buckets of (n, 2) uint64 digests; each bucket follows from the other one."""
    mark = (keys[:, 0] >> np.uint64(32)).astype(np.uint32)
    mark[mark == 0] = 1
    first = keys[:, 1] % np.uint64(n_buckets)
    return mark, first, first ^ _hop(mark, n_buckets)


def _hop(mark, n_buckets: int):
    return (mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(n_buckets)


class Cuckoo:
    """Cuckoo filter with 32-bit fingerprints in buckets of four; the bucket count is a power of two."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n_keys: int) -> "Cuckoo":
        n = 1
        while n * SLOTS * 0.8 < n_keys + 8:
            n *= 2
        return cls(np.zeros((n, SLOTS), np.uint32))

    @classmethod
    def of(cls, keys: np.ndarray, at_least: int = 0) -> "Cuckoo":
        new = cls.sized(max(len(keys), at_least))
        while not new.add(keys):
            new = cls(np.zeros((2 * len(new.table), SLOTS), np.uint32))
        return new

    def add(self, keys: np.ndarray) -> bool:
        """Insert all keys; False if one finds no place (the caller rebuilds a larger filter)."""
        rng = np.random.default_rng(1)
        for mark, a, b in zip(*_places(keys, len(self.table))):
            for _ in range(MAX_KICKS):
                spot = next(((x, s) for x in (a, b) for s in range(SLOTS) if not self.table[x, s]), None)
                if spot:
                    self.table[spot] = mark
                    break
                slot = int(rng.integers(SLOTS))
                mark, self.table[a, slot] = self.table[a, slot], mark
                b = a = a ^ _hop(np.array([mark]), len(self.table))[0]
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Take out one copy of each key's fingerprint; only for keys that were added."""
        for mark, a, b in zip(*_places(keys, len(self.table))):
            spot = next(((x, s) for x in (a, b) for s in range(SLOTS) if self.table[x, s] == mark), None)
            if spot:
                self.table[spot] = 0

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = _places(keys, len(self.table))
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(axis=1)


def _pairs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


class Filters:
    """All shards' filters and the keys they wrongly hold, as one broadcast value."""

    def __init__(self, tables: dict[int, np.ndarray], n_shards: int, exceptions=()):
        self.shards, self.n_shards = {s: Cuckoo(t) for s, t in tables.items()}, n_shards
        self.exceptions = frozenset(exceptions)

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Which keys the filters hold, exceptions included."""
        pairs, out = _pairs(keys), np.zeros(len(keys), bool)
        shard = pairs[:, 0] % np.uint64(self.n_shards)
        for s in np.unique(shard).tolist():
            if s in self.shards:
                at = np.flatnonzero(shard == s)
                out[at] = self.shards[s].holds(pairs[at])
        return out

    def dropped(self, keys: list[bytes]) -> np.ndarray:
        out = self.probe(keys)
        for i in np.flatnonzero(out) if self.exceptions else ():
            out[i] = keys[i] not in self.exceptions
        return out


# -- reference counts ---------------------------------------------------------

def _count_task(min_chars: int, sign: int):
    def run(batches):
        for batch in sliced(batches):
            n: dict[bytes, int] = {}
            for text in _texts(batch, 0):
                for key in {line_key(x, min_chars) for x in text.split(b"\n")} - {None}:
                    n[key] = n.get(key, 0) + sign
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())],
                                             names=["key", "n"])
    return run


class LineDedup:
    """A line-dedup state in the shared folder.  Every row of ``documents`` is one document."""

    def __init__(self, spark, min_docs: int = 10, min_chars: int = 1, shard_keys: int = SHARD_KEYS,
                 broadcast_mb: float = BROADCAST_MB):
        self.spark, self.min_docs, self.min_chars, self.shard_keys = spark, min_docs, min_chars, shard_keys
        self.broadcast_mb, self.n_shards = broadcast_mb, 0
        self.counts = self.filters = None

    def insert(self, docs: DataFrame) -> "LineDedup":
        """Count the lines of new documents (column ``text``)."""
        return self._merge(docs, 1)

    def delete(self, docs: DataFrame) -> "LineDedup":
        """Undo the insertion of these documents (their texts as inserted)."""
        return self._merge(docs, -1)

    def _merge(self, docs: DataFrame, sign: int) -> "LineDedup":
        change = docs.select("text").mapInArrow(_count_task(self.min_chars, sign), "key binary, n long")
        old = self.counts
        rows = change.select("key", F.lit(0).cast("long").alias("old"), "n")
        if old is not None:
            rows = rows.unionByName(old.select("key", F.col("n").alias("old"), "n"))
        merged = rows.groupBy("key").agg(F.sum("old").alias("old"), F.sum("n").alias("n"))
        merged = self._write(merged.where((F.col("n") > 0) | (F.col("old") > 0)), "line-counts")
        self.counts = merged.where(F.col("n") > 0).select("key", "n")
        crossed = merged.where((F.col("n") >= self.min_docs) != (F.col("old") >= self.min_docs))
        self._refilter(crossed.select("key", (F.col("n") >= self.min_docs).alias("add")))
        return self

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _refilter(self, crossed: DataFrame) -> None:
        if self.filters is not None:
            change = crossed.select(_shard_of("key", self.n_shards), "key", "add")
            self.filters = self._write(
                self.filters.groupBy("shard").cogroup(change.groupBy("shard"))
                .applyInArrow(_change_shard, "shard int, table binary"), "line-filters")
            if self.filters.where(F.length("table") == 0).limit(1).count() == 0:
                return
        # first build, or a shard ran full: new filters from the exact counts, with shards of bounded size
        full = self.counts.where(F.col("n") >= self.min_docs)
        n_full, n_shards = full.count(), 1
        while n_shards * self.shard_keys < n_full:
            n_shards *= 2
        self.n_shards = n_shards
        self.filters = self._write(full.select(_shard_of("key", n_shards), "key").groupBy("shard")
                                   .applyInArrow(_build_shard, "shard int, table binary"), "line-filters")

    def _shared(self) -> "Filters | None":
        """Filters and exceptions for a broadcast, or None if they exceed its bound."""
        limit = self.broadcast_mb * 1e6
        size = self.filters.select(F.coalesce(F.sum(F.length("table")), F.lit(0)).alias("b")).first()["b"]
        if size > limit:
            return None
        tables = {r["shard"]: np.frombuffer(r["table"], np.uint32).reshape(-1, SLOTS)
                  for r in self.filters.toLocalIterator()}  # bounded by broadcast_mb
        probe = self.spark.sparkContext.broadcast(Filters(tables, self.n_shards))

        def wrong(batches):
            for batch in sliced(batches):
                held = probe.value.probe(batch.column(0).to_pylist()) if batch.num_rows else np.zeros(0, bool)
                yield batch.filter(pa.array(held))

        false = self._write(self.counts.where(F.col("n") < self.min_docs).select("key")
                            .mapInArrow(wrong, "key binary"), "line-exceptions")
        if size + 100 * false.count() > limit:
            return None
        return Filters(tables, self.n_shards, [r["key"] for r in false.toLocalIterator()])  # bounded by broadcast_mb

    def apply(self, docs: DataFrame) -> DataFrame:
        """Documents without their repeated lines: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

        Keys counted in at least ``min_docs`` documents lose all their lines.  A null or empty text is
        one empty line; keys shorter than ``min_chars`` code points always stay; an empty table gives no rows.
        Repeated rows count as separate documents.  Other columns are ignored.
        """
        return self._pass(docs.select("doc_id", "text"), _report, RESULT)

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """``docs`` with its columns and rows, repeated lines taken out of ``text``; ``n_chars``, if there, follows.

        A null text stays null.
        """
        return self._pass(docs, _rewrite(docs.columns), docs.schema)

    def _pass(self, docs: DataFrame, make, schema) -> DataFrame:
        at, min_chars = docs.columns.index("text"), self.min_chars
        filters = self._shared()
        if filters is not None:
            shared = self.spark.sparkContext.broadcast(filters)

            def run(batches):
                for batch in sliced(batches):
                    texts = [t.split(b"\n") for t in _texts(batch, at)]
                    keys = [[line_key(x, min_chars) for x in lines] for lines in texts]
                    distinct = list({k for own in keys for k in own} - {None})
                    gone = shared.value.dropped(distinct) if distinct else ()
                    yield make(batch, texts, keys, [{k for k, g in zip(distinct, gone) if g}] * len(texts))

            return docs.mapInArrow(run, schema)
        # beyond the broadcast bound: each document's distinct keys join the counts, and meet its text again
        names = [f"c{i}" for i in range(len(docs.columns))]  # no name of a column can clash with one made here
        id_, columns = names[docs.columns.index("doc_id")], docs.columns
        docs = docs.toDF(*names).withColumn("_row", F.xxhash64(id_, names[at]))
        keys = docs.select("_row", names[at]).mapInArrow(_keys_task(min_chars), "row long, key binary").distinct()
        gone = (keys.join(self.counts.where(F.col("n") >= self.min_docs).select("key"), "key")
                .groupBy("row").agg(F.collect_set("key").alias("_gone")))

        def joined(batches):
            for batch in sliced(batches):
                texts = [t.split(b"\n") for t in _texts(batch, at)]
                keys = [[line_key(x, min_chars) for x in lines] for lines in texts]
                gone = batch.column(batch.num_columns - 1).to_pylist()
                yield make(batch.select(range(len(columns))).rename_columns(columns), texts, keys, [set(x or ()) for x in gone])

        return docs.join(gone, docs["_row"] == gone["row"], "left").drop("_row", "row").mapInArrow(joined, schema)


def _shard_of(key, n_shards: int):
    """Shard of a key: its first eight bytes, little end first, modulo a power of two (at most 2^32)."""
    value = F.lit(0).cast("long")
    for i in range((n_shards.bit_length() + 6) // 8):
        value = value + F.conv(F.substring(F.hex(key), 1 + 2 * i, 2), 16, 10).cast("long") * F.lit(256 ** i)
    return F.pmod(value, F.lit(n_shards)).cast("int").alias("shard")


def _shard_row(shard: int, table: bytes) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "table": pa.array([table], pa.binary())})


def _build_shard(group: pa.Table) -> pa.Table:
    new = Cuckoo.of(_pairs(sorted(group["key"].to_pylist())))
    return _shard_row(group["shard"][0].as_py(), new.table.tobytes())


def _change_shard(old: pa.Table, change: pa.Table) -> pa.Table:
    shard = (old if len(old) else change)["shard"][0].as_py()
    add, gone = (_pairs(sorted(k for k, a in zip(change["key"].to_pylist(), change["add"].to_pylist()) if a == which))
                 for which in (True, False))
    table = np.frombuffer(old["table"][0].as_py(), np.uint32).reshape(-1, SLOTS).copy() if len(old) else Cuckoo.sized(2 * len(add)).table
    new = Cuckoo(table)
    new.remove(gone)
    return _shard_row(shard, new.table.tobytes() if new.add(add) else b"")  # b"": full


def _keys_task(min_chars: int):
    def run(batches):
        for batch in sliced(batches):
            rows, keys = [], []
            for row, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                own = {line_key(x, min_chars) for x in text.split(b"\n")} - {None}
                keys += own
                rows += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys, pa.binary())],
                                             names=["row", "key"])
    return run


def _kept(texts, keys, gone) -> list[bytes]:
    return [b"\n".join(x for x, k in zip(lines, own) if k not in drop) for lines, own, drop in zip(texts, keys, gone)]


def _report(batch, texts, keys, gone):
    kept = _kept(texts, keys, gone)
    return pa.RecordBatch.from_arrays([
        batch.column(0), pa.array([len(x) for x in texts], pa.int64()),
        pa.array([sum(k in drop for k in own) for own, drop in zip(keys, gone)], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def _rewrite(columns: list[str]):
    at, length = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def make(batch, texts, keys, gone):
        null = batch.column(at).is_null().to_pylist()
        kept = [None if n else x.decode() for n, x in zip(null, _kept(texts, keys, gone))]
        out = [batch.column(i) for i in range(len(columns))]
        out[at] = pa.array(kept, pa.string())
        if length is not None:
            out[length] = pa.array([None if x is None else len(x) for x in kept], out[length].type)
        return pa.RecordBatch.from_arrays(out, names=columns)
    return make


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, **options) -> DataFrame:
    """One-shot form: count all documents, then drop their repeated lines (see ``LineDedup.apply``)."""
    return LineDedup(docs.sparkSession, min_docs, min_chars, **options).insert(docs).apply(docs)
