"""Vector retrieval (#44-#48, #50, #51): hashed TF-IDF encoders, exact dot/cosine search, flat index,
scalar quantisation and bucketed (LSH) search.

Exact search never materialises all (query, doc) pairs.  Queries lie in chunks of at most ``BLOCK_CELLS`` vector entries and
``CHUNK_HITS`` kept rows, one chunk a task; the corpus is dealt to every chunk and streams past its queries, in tiles of scores
(``functions.vectors``).  A task holds its chunk and its running top-k alone, whatever the corpus; since it sees the whole
corpus, it emits about k rows a query, which a window (WindowGroupLimit) then ranks.  The number of chunks never changes the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift import constants as C
from docsift.functions.text import tokenize
from docsift.functions.vectors import RunningTopK, block_topk, normalize_rows, ranges, stack
from docsift.operators.lexical import rank_top_k, shuffle_partitions
from docsift.session import spread

#: vector entries (rows * dim) of a task's chunk of queries
BLOCK_CELLS = 8_000_000
#: rows that the running top-k of a chunk keeps (queries * k)
CHUNK_HITS = 1_500_000
#: queries that are worth a chunk of their own
CHUNK_QUERIES = 1024
#: steps of a query's largest weight in the integer SQ scan
SQ_LEVELS = 32_767
#: terms whose statistics are broadcast to their postings (tens of MB); those of all others are shuffled
HEAVY_TERMS = 1 << 18
#: corpus rows per LSH bucket chunk
BUCKET_CHUNK_ROWS = 20_000


def hit_schema(qtype, dtype):
    return T.StructType([T.StructField("query_id", qtype), T.StructField("doc_id", dtype),
                         T.StructField("score", T.DoubleType())])


def hit_batch(qi, di, sc, schema) -> pa.RecordBatch:
    """Query ids, document ids and scores as one Arrow batch of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(schema)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).tolist(), t) for x, t in zip((qi, di, sc), types)], names=schema.names)


def finish(hits: DataFrame, k: int) -> DataFrame:
    """Hits ranked per query (rounded score, then id) and cut to ``k``."""
    return rank_top_k(hits, k).select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


# ---------------------------------------------------------------------------
# hashed TF-IDF encoders (#44, #45)
# ---------------------------------------------------------------------------

def hash_bucket(term, dim: int):
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def hash_sign(term):
    return F.when(F.substring(F.md5(term), 9, 1) < F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0))


def term_stats(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", index=None):
    """(id, term, tf) and (term, df, idf) with smooth idf = ln((1+N)/(1+df)) + 1 (N = all corpus rows).

    With a ``LexicalIndex`` built on the same corpus and tokenizer, its postings and
    document frequencies are reused instead of tokenising again.
    """
    n = corpus.count()
    if index is not None and index.analyzer is None:
        tf = index.postings.select(F.col("doc_id").alias("id"), "term", "tf")
        df = index.terms.select("term", "df")
    else:
        tf = (spread(corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")))
              .select("id", F.explode_outer(tokenize(F.col("_t"))).alias("term")).where(F.col("term").isNotNull())
              .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", "df", (F.log(F.lit(float(1 + n)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    return tf, idf


def split_term_join(tf: DataFrame, terms: DataFrame, heavy: int | None = None, n_parts: int | None = None) -> DataFrame:
    """``tf`` with the columns of ``terms`` (one row a term, with its document frequency ``df``), skew-free.

    With P postings in all, at most ``heavy`` terms have P / heavy or more: these are broadcast, so their postings stay
    where they are.  The postings of the other terms meet their rows in a shuffle, none with more than P / heavy of them.
    ``heavy`` is ``HEAVY_TERMS``, or 16 for each shuffle partition.  Where ``tf`` lies in ``n_parts`` partitions by its ``id``,
    so does the result: only the shuffled postings go back to them.
    """
    spark = tf.sparkSession
    heavy = heavy or max(HEAVY_TERMS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = terms.agg(F.sum("df")).first()[0] or 0
    many = F.col("df") * heavy >= total
    columns = [c for c in terms.columns if c not in ("term", "df")]
    found = tf.join(F.broadcast(terms.where(many).drop("df")), "term", "left")  # at most ``heavy`` rows
    rest = found.where(F.col(columns[0]).isNull()).drop(*columns).join(terms.where(~many).drop("df"), "term")
    rest = rest.repartition(n_parts, "id") if n_parts else rest
    return found.where(F.col(columns[0]).isNotNull()).unionByName(rest)


def encode_sparse(tf: DataFrame, idf: DataFrame, dim: int, weighting: str = "log", heavy: int | None = None,
                  n_parts: int | None = None) -> DataFrame:
    """Signed hashed TF-IDF: (id, dim, w), L2-normalised per id.

    weighting 'log': (1 + ln tf) * idf (document tower); 'binary': idf (query tower).
    The md5 bucket and sign are computed once per distinct term, not per posting; no task holds a frequent
    term's postings (``split_term_join``).  The weights are dealt out by id once; sums, norms and whatever groups the
    result by id stay there.
    """
    tfw = F.lit(1.0) + F.log(F.col("tf").cast("double")) if weighting == "log" else F.lit(1.0)
    hashed = idf.select("term", "df", hash_bucket(F.col("term"), dim).alias("dim"), hash_sign(F.col("term")).alias("sign"), "idf")
    x = split_term_join(tf, hashed, heavy, n_parts).select("id", "dim", (F.col("sign") * tfw * F.col("idf")).alias("w"))
    if not n_parts:
        x = x.repartition(shuffle_partitions(tf), "id")
    x = x.groupBy("id", "dim").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))  # at most ``dim`` rows an id
    return x.withColumn("norm", norm).where(F.col("norm") > 0).select("id", "dim", (F.col("w") / F.col("norm")).alias("w"))


def _parts_of(index) -> int | None:
    """Partitions that an index's postings lie in by document, where they are known."""
    return index.n_parts if index is not None and index.analyzer is None and index.n_parts > 1 else None


def encode_hashed_tfidf(corpus: DataFrame, dim: int = 256, id_col: str = "doc_id", text_col: str = "text",
                        index=None) -> DataFrame:
    tf, idf = term_stats(corpus, id_col, text_col, index)
    return encode_sparse(tf, idf, dim, "log", n_parts=_parts_of(index))


def encode_two_tower(queries: DataFrame, corpus: DataFrame, dim: int = 256, query_id: str = "query_id",
                     doc_id: str = "doc_id", text_col: str = "text", index=None, doc_ids: DataFrame | None = None):
    """Separate towers sharing the corpus idf: queries binary*idf, documents (1+ln tf)*idf.

    ``doc_ids`` (one ``id`` column) restricts the document tower to those documents
    (e.g. rerank candidates); idf still comes from the whole corpus.
    """
    tf, idf = term_stats(corpus, doc_id, text_col, index)
    if doc_ids is not None:
        tf = tf.join(doc_ids.select("id").distinct(), "id", "left_semi")
    qtf = (spread(queries.select(F.col(query_id).alias("id"), F.col(text_col).alias("_t")))
           .select("id", F.explode_outer(tokenize(F.col("_t"))).alias("term")).where(F.col("term").isNotNull())
           .groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    return encode_sparse(qtf, idf, dim, "binary"), encode_sparse(tf, idf, dim, "log", n_parts=_parts_of(index))


def to_dense(sparse: DataFrame, dim: int) -> DataFrame:
    """(id, dim, w) -> (id, embedding array<double>[dim]); one row per id (at most ``dim`` entries)."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def densify(dims: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for d, w in zip(dims, ws):
            v = np.zeros(dim)
            v[np.asarray(d, dtype=np.int64)] = np.asarray(w, dtype=np.float64)
            out.append(v)
        return pd.Series(out)
    g = sparse.groupBy("id").agg(F.collect_list("dim").alias("d"), F.collect_list("w").alias("w"))
    return g.select("id", densify("d", "w").alias("embedding"))


def sparse_dot(pairs: DataFrame, qvec: DataFrame, dvec: DataFrame) -> DataFrame:
    """Score given (query_id, doc_id) pairs by the sparse dot product of their vectors."""
    left = pairs.join(qvec.select(F.col("id").alias("query_id"), "dim", F.col("w").alias("wq")), "query_id")
    return (dvec.select(F.col("id").alias("doc_id"), "dim", F.col("w").alias("wd")).join(left, ["doc_id", "dim"])
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("wq") * F.col("wd")).alias("score")))


# ---------------------------------------------------------------------------
# exact search (#46-#48)
# ---------------------------------------------------------------------------

def _kernel_frame(qi, di, sc):
    return pd.DataFrame({"query_id": qi, "doc_id": di, "score": sc})


def matrix(column) -> np.ndarray:
    """Arrow list column (rows of one length) as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def query_blocks(queries: DataFrame, cells_per_row: int, block_cells: int | None = None) -> list[DataFrame]:
    """``queries`` in blocks of about ``block_cells`` entries (of ``cells_per_row`` each)."""
    n = max(1, math.ceil(queries.count() * max(cells_per_row, 1) / (block_cells or BLOCK_CELLS)))
    return [queries.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else queries for i in range(n)]


def chunk_count(queries: DataFrame, cells_per_row: int, k: int, block_cells: int | None = None) -> int:
    """Chunks of ``queries``: bounded in entries and kept rows, and enough for all cores where there are many queries."""
    rows = queries.count()
    bounds = (rows * max(cells_per_row, 1) / (block_cells or BLOCK_CELLS), rows * k / CHUNK_HITS,
              min(queries.sparkSession.sparkContext.defaultParallelism, rows / CHUNK_QUERIES))
    return max(1, *map(math.ceil, bounds))


def numbers_of(ids: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``asked``, position in ``ids``) of all equal pairs."""
    order = np.argsort(ids, kind="stable")
    low, high = np.searchsorted(ids[order], asked, "left"), np.searchsorted(ids[order], asked, "right")
    return np.repeat(np.arange(len(asked)), high - low), order[ranges(low, high)]


def streamed_hits(queries: DataFrame, corpus: DataFrame, n_chunks: int, search, schema, excluded: DataFrame | None = None,
                  n_parts: int = 1) -> DataFrame:
    """(query_id, doc_id, raw score): ``search`` over chunks of ``queries`` (id, ...), past which all of ``corpus`` (id, ...) streams.

    A task gets a chunk's queries, its ``excluded`` pairs (query_id, doc_id) and then the corpus, in this order.
    With ``n_parts`` the corpus is cut into that many parts, each for a task of its own, which emits the part's hits.
    ``search(columns)`` of the queries' Arrow columns by name gives a ``RunningTopK`` and a function that feeds it a
    batch's ids and columns by name; ``corpus`` columns other than the id must not share names with the queries'.
    """
    qid, cid = queries.schema["id"].dataType, corpus.schema["id"].dataType
    mine, theirs = [c for c in queries.columns if c != "id"], [c for c in corpus.columns if c != "id"]
    share = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # a task is a chunk of queries and a part of the corpus
    chunk = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda p: share(c, n_chunks) * n_parts + p)).alias("_c")

    def rows(df, chunk, side, q, d):
        null = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
        return df.select(chunk, F.lit(side).alias("_s"), q.alias("_q"), d.alias("_d"),
                         *[F.col(c) if side == 0 else null(queries, c) for c in mine],
                         *[F.col(c) if side == 2 else null(corpus, c) for c in theirs])
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda c: c * n_parts + share("id", n_parts))).alias("_c")
    stream = rows(queries, chunk("id"), 0, F.col("id"), F.lit(None).cast(cid)).unionByName(
        rows(spread(corpus), every, 2, F.lit(None).cast(qid), F.col("id")))
    if excluded is not None:
        pairs = excluded.select(F.col("query_id").cast(qid).alias("query_id"), F.col("doc_id").cast(cid).alias("doc_id"))
        stream = stream.unionByName(rows(pairs, chunk("query_id"), 1, F.col("query_id"), F.col("doc_id")))
    stream = stream.repartitionById(n_chunks * n_parts, F.col("_c")).sortWithinPartitions("_c", "_s")

    def results(state):
        if state is not None:
            yield hit_batch(*state[0].finished(), schema)

    def run(batches):
        chunk, held, state = None, {0: [], 1: []}, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            cuts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else []
            for start, end in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                part, here, side = batch.slice(start, end - start), keys[0, start], keys[1, start]
                if here != chunk:
                    yield from results(state)
                    chunk, held, state = here, {0: [], 1: []}, None
                if side < 2:
                    held[side].append(part)
                    continue
                if state is None and held[0]:
                    table = pa.Table.from_batches(held[0])
                    state = search({"id": table.column("_q").to_numpy(), **{c: table.column(c) for c in mine}})
                    if held[1]:
                        pairs = pa.Table.from_batches(held[1])
                        docs, asked = pairs.column("_d").to_numpy(), pairs.column("_q").to_numpy()
                        at, number = numbers_of(state[0].qids, asked)
                        by = np.argsort(docs[at], kind="stable")
                        state[0].excluded = (docs[at][by], number[by])
                    held = {0: [], 1: []}
                if state is not None:
                    state[1](part.column("_d").to_numpy(zero_copy_only=False), {c: part.column(c) for c in theirs})
        yield from results(state)
    return stream.mapInArrow(run, schema)


def dense_hits(ids: np.ndarray, q: np.ndarray, corpus: DataFrame, schema, k: int, metric: str = "dot", exclude_self: bool = False,
               max_score: float | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, raw score) of one block of queries: rows that contain every query's exact top k."""
    spark = corpus.sparkSession
    cos = metric in ("cos", "cos_sim", "cosine")
    pairs = None
    if excluded is not None:  # bounded: each task gets a document's list within the block, joined by the document's id
        numbers = spark.createDataFrame(pa.table({"query_id": pa.array(ids.tolist()), "_n": pa.array(np.arange(len(ids)), pa.int32())}))
        pairs = (excluded.join(F.broadcast(numbers), "query_id").groupBy(F.col("doc_id").alias("id"))
                 .agg(F.collect_set("_n").alias("_out")))
    shared, has_lists = spark.sparkContext.broadcast((ids, normalize_rows(q) if cos and len(q) else q)), pairs is not None

    def run(batches):
        # one running top-k over all batches of the partition, so the rows it emits do not depend on the batch size
        qids, qm = shared.value
        top = RunningTopK(qids, qm, k, exclude_self, max_score=max_score)
        for batch in batches:
            if not batch.num_rows or not len(qm):
                continue
            pdf = batch.to_pandas()
            d = stack(pdf["embedding"], qm.shape[1])
            doc_ids = pdf["id"].to_numpy()
            if has_lists:
                out = [np.empty(0, int) if x is None else np.asarray(x, int) for x in pdf["_out"]]
                by = np.argsort(doc_ids, kind="stable")
                top.excluded = (np.repeat(doc_ids[by], [len(out[i]) for i in by]), np.concatenate([out[i] for i in by]))
            top.add(doc_ids, normalize_rows(d) if cos else d)
        yield hit_batch(*top.result(), schema)

    rows = spread(corpus.select("id", "embedding"))
    if pairs is not None:
        rows = rows.join(pairs, "id", "left")
    return rows.mapInArrow(run, schema)


def dense_search(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "dot", exclude_self: bool = False,
                 max_score: float | None = None, excluded: DataFrame | None = None, block_cells: int | None = None) -> DataFrame:
    """Exact top-k run (query_id, doc_id, score rounded to 6, rank) by dot product or cosine.

    With ``max_score`` the top k of the documents whose rounded score is below it; ``excluded`` (query_id, doc_id) are
    pairs left out inside the search, so ``k`` need not grow with them.
    """
    schema = hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)
    cos = metric in ("cos", "cos_sim", "cosine")
    first = queries.select("embedding").first()

    def search(columns):
        q = matrix(columns["embedding"])
        top = RunningTopK(columns["id"], normalize_rows(q) if cos else q, k, exclude_self, max_score=max_score)

        def feed(ids, batch):
            d = matrix(batch["vector"])
            top.add(ids, normalize_rows(d) if cos else d)
        return top, feed
    chunks = chunk_count(queries, len(first[0]) if first else 1, k, block_cells)
    # with few queries the corpus is cut, or one task would sort and search all of it
    parts = -(-max(shuffle_partitions(corpus), corpus.sparkSession.sparkContext.defaultParallelism) // chunks)
    return finish(streamed_hits(queries.select("id", "embedding"), corpus.select("id", F.col("embedding").alias("vector")), chunks,
                                search, schema, excluded, parts), k)


# ---------------------------------------------------------------------------
# scalar quantisation (#51)
# ---------------------------------------------------------------------------

def sq_fit(corpus: DataFrame):
    """Per-dimension (min, max): an aggregate with one row per dimension (bounded by dim)."""
    per_dim = (corpus.select(F.posexplode("embedding").alias("i", "x"))
               .groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
               .orderBy("i").collect())  # bounded: one row per dimension
    lo = [r["lo"] for r in per_dim]
    hi = [r["hi"] for r in per_dim]
    return lo, hi


def sq_encode(corpus: DataFrame, lo, hi) -> DataFrame:
    """8-bit codes per dimension: round((x - lo) / (hi - lo) * 255)."""
    lo_a, hi_a = F.array(*[F.lit(float(v)) for v in lo]), F.array(*[F.lit(float(v)) for v in hi])
    code = F.transform("embedding", lambda x, i: F.when(
        F.element_at(hi_a, i + 1) > F.element_at(lo_a, i + 1),
        F.round((x.cast("double") - F.element_at(lo_a, i + 1)) / (F.element_at(hi_a, i + 1) - F.element_at(lo_a, i + 1))
                * F.lit(255.0))).otherwise(F.lit(0.0)).cast("int"))
    return corpus.select("id", code.alias("codes"))


def sq_weights(q: np.ndarray, lo, hi):
    """(offset, scale, integer weights) of each query: score = offset + scale * (weights . codes).

    A query's weights q_i * (hi_i - lo_i) / 255 are rounded to ``SQ_LEVELS`` steps of their largest magnitude.
    """
    lo, span = np.asarray(lo), (np.asarray(hi) - np.asarray(lo)) / 255.0
    w = q * span[None, :]
    scale = np.abs(w).max(axis=1, initial=0.0) / SQ_LEVELS
    scale[scale == 0] = 1.0
    return q @ lo, scale, np.floor(w / scale[:, None] + 0.5)


def sq_search(queries: DataFrame, corpus: DataFrame, k: int = 10, exclude_self: bool = False) -> DataFrame:
    """SQ8 search: integer products of the queries' weights with the byte codes, one rescale a query.

    Codes are never decoded.  Weights and codes are integers, so the products are exact whatever the order of the sum (they
    stay far below 2^53, where floating-point matrix products are exact too).
    """
    lo, hi = sq_fit(corpus)
    coded = sq_encode(corpus, lo, hi).select("id", F.transform("codes", lambda c: (c - 128).cast("tinyint")).alias("codes"))
    schema = hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)

    def search(columns):
        offset, scale, weights = sq_weights(matrix(columns["embedding"]), lo, hi)
        top = RunningTopK(columns["id"], weights, k, exclude_self)

        def feed(ids, batch):
            codes = matrix(batch["codes"]) + 128.0
            top.score(ids, lambda rows, a, b: offset[None, a:b] + scale[None, a:b] * (codes[rows] @ weights[a:b].T))
        return top, feed
    return finish(streamed_hits(queries.select("id", "embedding"), coded, chunk_count(queries, len(lo), k), search, schema), k)


# ---------------------------------------------------------------------------
# bucketed approximate search: random-hyperplane LSH (#50)
# ---------------------------------------------------------------------------

def lsh_buckets(df: DataFrame, n_tables: int, n_bits: int, dim: int, seed: int = 7) -> DataFrame:
    """(id, embedding, tbl, bucket): one row per hash table; bucket = sign bits of plane dot products."""
    planes = np.asarray(C.hyperplanes(n_tables, n_bits, dim, seed))       # (L, B, d)
    bc = df.sparkSession.sparkContext.broadcast(planes)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def keys(emb: pd.Series) -> pd.Series:
        p = bc.value
        x = stack(emb, p.shape[2])
        bits = (np.einsum("nd,lbd->nlb", x, p) > 0).astype(np.int64)
        k = (bits * (1 << np.arange(p.shape[1]))[None, None, :]).sum(axis=2)
        return pd.Series(list(k.astype(np.int32)))
    return (df.select("id", "embedding", F.posexplode_outer(keys("embedding")).alias("tbl", "bucket"))
            .where(F.col("bucket").isNotNull()))


def ann_search(queries: DataFrame, corpus: DataFrame, k: int = 10, n_tables: int = 4, n_bits: int = 4,
               exclude_self: bool = False, chunk_rows: int = BUCKET_CHUNK_ROWS, flips: int = 0) -> DataFrame:
    """Multi-table LSH: candidates share a bucket in some table; exact re-score; top-k.

    With ``flips`` a query also probes the buckets whose keys differ from its own in up to that many bits.
    ``n_bits`` decides the answer, so it is the caller's choice and never follows the corpus size.
    Hot buckets are cut into a grid: ceil(corpus rows / chunk_rows) corpus chunks times
    ceil(query rows / chunk_rows) query chunks; each chunk pair meets in one cogroup
    task, so no task holds more than ``chunk_rows`` vectors per side and every block
    emits only rows that can reach a query's top-k.
    """
    dim = len(corpus.select("embedding").first()[0])
    qb = lsh_buckets(queries, n_tables, n_bits, dim)
    if flips:
        masks = [m for m in range(1 << n_bits) if m.bit_count() <= flips]
        qb = (qb.withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
              .select("id", "embedding", "tbl", F.col("bucket").bitwiseXOR(F.col("mask")).alias("bucket")))
    hits = bucket_hits(qb, lsh_buckets(corpus, n_tables, n_bits, dim), ["tbl", "bucket"], k, exclude_self, chunk_rows)
    return finish(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def bucket_hits(qb: DataFrame, cb: DataFrame, keys: list[str], k: int, exclude_self: bool = False,
                chunk_rows: int = BUCKET_CHUNK_ROWS) -> DataFrame:
    """(query_id, doc_id, score) of the vectors that share a bucket: per chunk pair the rows that can reach a top k."""
    grid = (cb.groupBy(*keys).agg(F.count(F.lit(1)).alias("nd"))
            .join(qb.groupBy(*keys).agg(F.count(F.lit(1)).alias("nq")), keys)
            .select(*keys, F.greatest(F.lit(1), F.ceil(F.col("nd") / F.lit(chunk_rows))).cast("int").alias("ndc"),
                    F.greatest(F.lit(1), F.ceil(F.col("nq") / F.lit(chunk_rows))).cast("int").alias("nqc")))
    q = (qb.join(grid, keys)
         .withColumn("qc", F.pmod(F.xxhash64("id"), F.col("nqc")).cast("int"))
         .withColumn("dc", F.explode(F.sequence(F.lit(0), F.col("ndc") - 1)))
         .select("id", "embedding", *keys, "qc", "dc"))
    # fresh column names on the corpus side: a cogroup of two frames derived from the
    # same scan otherwise loses the shared attributes on the right
    c = (cb.join(grid, keys)
         .withColumn("dc", F.pmod(F.xxhash64("id"), F.col("ndc")).cast("int"))
         .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("nqc") - 1)))
         .select(F.col("id").alias("cid"), F.col("embedding").alias("cemb"), *keys, "qc", "dc"))
    schema = hit_schema(qb.schema["id"].dataType, cb.schema["id"].dataType)

    def pair(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return _kernel_frame([], [], [])
        a, b, cc = block_topk(qpdf["id"].to_numpy(), stack(qpdf["embedding"]), cpdf["cid"].to_numpy(),
                              stack(cpdf["cemb"]), k, exclude_self)
        return _kernel_frame(a, b, cc)
    gkeys = [*keys, "qc", "dc"]
    return q.groupBy(*gkeys).cogroup(c.groupBy(*gkeys)).applyInPandas(pair, schema)
