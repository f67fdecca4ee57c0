"""Trained vector indexes (#49, #50, #52-#54): k-means, inverted file, product quantisation and PCA.

Training is the same on every run: k-means starts from the vectors whose hashed ids sort first and does a fixed number
of Lloyd rounds, PCA does a fixed number of power iterations.  Each round is one pass of partial sums inside the tasks
and one grouped sum; the driver holds centres or a dim x dim matrix only.  k-means fits on at most ``FIT_ROWS`` vectors
(a hash-ordered sample); every vector is indexed.

Compressed searches keep ``depth`` candidates a query by their approximate scores and rank these by the exact ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift import constants as C
from docsift.functions.vectors import TILE_QUERIES, RunningTopK
from docsift.operators import dense as D
from docsift.operators.dense import matrix

#: Vectors that k-means is fitted on at most, rows compared with all centres at a time.
FIT_ROWS = 65_536
STEP_ROWS = 1024
#: Rows of lookup sums that are added up together.
SUM_ROWS = 64
#: Decimals of the distances that decide between centres (equal ones go to the first centre).
DISTANCE_DECIMALS = 9


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(axis=2)).round(DISTANCE_DECIMALS)


def _steps(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


# -- k-means ------------------------------------------------------------------

def hash_ordered(vectors: DataFrame, rows: int, seed: str = C.SPLIT_SEED) -> DataFrame:
    """The ``rows`` vectors whose hashed ids sort first."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return vectors.select("id", "embedding").withColumn("key", key).orderBy("key", "id").limit(rows)


def kmeans(vectors: DataFrame, k: int, rounds: int, m: int = 1, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """(m, k, dim / m) centres: one k-means for each of the ``m`` parts of the vectors, all in the same passes.

    Fewer than ``k`` vectors give as many centres; a centre without vectors stays where it is.
    """
    sample = hash_ordered(vectors, fit_rows).persist()
    start = matrix(hash_ordered(sample, k).select("embedding").toArrow().column(0))  # bounded: k vectors
    if not len(start):
        sample.unpersist()
        raise ValueError("k-means needs at least one vector")
    if start.shape[1] % m:
        raise ValueError(f"dimension {start.shape[1]} is not divisible by m={m}")
    centres = start.reshape(len(start), m, -1).transpose(1, 0, 2).copy()
    rows = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism, "id").select("embedding").persist()
    for _ in range(rounds):
        shared = sample.sparkSession.sparkContext.broadcast(centres)

        def partial(batches):
            c = shared.value
            total, n = np.zeros(c.shape), np.zeros(c.shape[:2], np.int64)
            for batch in _steps(batches):
                x = matrix(batch.column(0)).reshape(batch.num_rows, len(c), -1)
                for j in range(len(c)):
                    nearest = distances(x[:, j], c[j]).argmin(axis=1)
                    np.add.at(total[j], nearest, x[:, j])
                    n[j] += np.bincount(nearest, minlength=c.shape[1])
            place = np.indices(c.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([*[pa.array(p, pa.int32()) for p in place], pa.array(total.ravel()),
                                              pa.array(np.repeat(n.ravel(), c.shape[2]))], names=["j", "c", "i", "total", "n"])

        sums = (rows.mapInArrow(partial, "j int, c int, i int, total double, n long").groupBy("j", "c", "i")
                .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow())  # bounded: one row a centre and dimension
        j, c, i, total, n = (sums.column(x).to_numpy() for x in range(5))
        held = n > 0
        centres[j[held], c[held], i[held]] = total[held] / n[held]
        shared.destroy()
    rows.unpersist()
    sample.unpersist()
    return centres


# -- inverted file (#50) ------------------------------------------------------

def ivf_lists(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(id, embedding, list): every vector with its ``probes`` nearest lists, nearest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(embedding):
        import pandas as pd

        from docsift.functions.vectors import stack
        out = []
        for start in range(0, len(embedding), STEP_ROWS):
            x = stack(embedding.iloc[start:start + STEP_ROWS], shared.value.shape[1])
            out += list(np.argsort(distances(x, shared.value), axis=1, kind="stable")[:, :probes].astype(np.int32))
        return pd.Series(out)
    return vectors.select("id", "embedding", F.explode(nearest("embedding")).alias("list"))


def ivf_search(queries: DataFrame, corpus: DataFrame, k: int = 10, n_lists: int = 32, n_probe: int = 22, rounds: int = 5,
               exclude_self: bool = False, chunk_rows: int = D.BUCKET_CHUNK_ROWS) -> DataFrame:
    """Inverted file: a query is scored exactly against the vectors of its ``n_probe`` nearest lists.

    Lists are k-means cells; the share of the corpus that a query scans is about ``n_probe / n_lists``.  Hot lists are
    cut into chunks on both sides (``dense.bucket_hits``), so no task holds a whole one.
    """
    centres = kmeans(corpus, n_lists, rounds)[0]
    hits = D.bucket_hits(ivf_lists(queries, centres, n_probe), ivf_lists(corpus, centres, 1), ["list"], k, exclude_self, chunk_rows)
    return D.finish(hits, k)


# -- product quantisation (#49) -----------------------------------------------

def pq_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, codes binary, other columns): one byte a part, the nearest of at most 256 centres."""
    if books.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 centres")
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    others = [f for f in vectors.schema.fields if f.name not in ("id", "embedding")]
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("codes", T.BinaryType()), *others])

    def encode(batches):
        b = shared.value
        for batch in _steps(batches):
            x = matrix(batch.column(1)).reshape(batch.num_rows, len(b), -1)
            codes = np.stack([distances(x[:, j], b[j]).argmin(axis=1) for j in range(len(b))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in codes], pa.binary()), *batch.columns[2:]],
                                             names=schema.names)
    return vectors.select("id", "embedding", *[f.name for f in others]).mapInArrow(encode, schema)


class Reranked(RunningTopK):
    """A running top-``depth`` by an approximate score; what it emits are the best ``best`` of it by exact products.

    A document's exact product with a query is taken when it enters, so no vector is looked up a second time.
    """

    def __init__(self, qids, q, depth, exclude_self, exact, best):
        super().__init__(qids, q, depth, exclude_self)
        self.exact, self.best = exact, best

    def second(self, d: np.ndarray):
        return lambda r, c: np.einsum("ij,ij->i", d[r], self.exact[c])

    def finished(self):
        return self.ranked(self.best)


def _top(columns, q, depth, exclude_self, best):
    """(running top, second scores of a batch's columns) of a scan with or without exact vectors."""
    if best is None:
        return RunningTopK(columns["id"], q, depth, exclude_self), lambda batch: None
    top = Reranked(columns["id"], q, depth, exclude_self, matrix(columns["exact"]), best)
    return top, lambda batch: top.second(matrix(batch["vector"]))


def _scan(queries: DataFrame, corpus: DataFrame, cells: int, depth: int, best: int | None, search) -> DataFrame:
    """The run of ``search``, with exact vectors in ``exact`` (queries) and ``vector`` (corpus) where ``best`` is given."""
    schema = D.hit_schema(queries.schema["id"].dataType, corpus.schema["id"].dataType)
    return D.finish(D.streamed_hits(queries, corpus, D.chunk_count(queries, cells, depth), search, schema), best or depth)


def pq_scan(queries: DataFrame, codes: DataFrame, books: np.ndarray, depth: int, exclude_self: bool = False,
            best: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): each query's best ``depth`` by the sum of its lookup table's entries.

    A query's table holds its product with every centre of every part; the byte codes stream past a chunk of tables.  No
    vector is decoded.  With ``best``, the ``best`` of these by the products of ``exact`` (queries) and ``vector`` (codes).
    """
    m = len(books)

    def search(columns):
        q = matrix(columns["embedding"])
        top, second = _top(columns, q, depth, exclude_self, best)
        tables = [np.ascontiguousarray(np.einsum("qjs,jcs->jcq", q[a:b].reshape(b - a, m, -1), books)) for a, b in top.tiles()]

        def feed(ids, batch):
            code = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, m).astype(np.intp)

            def scores(rows, a, b):
                table, part = tables[a // TILE_QUERIES], code[rows]
                out = np.empty((len(part), b - a))
                for low in range(0, len(part), SUM_ROWS):  # sums of a few rows stay in the core's cache
                    some, sums = part[low:low + SUM_ROWS], out[low:low + SUM_ROWS]
                    np.take(table[0], some[:, 0], axis=0, out=sums, mode="clip")
                    held = np.empty_like(sums)
                    for j in range(1, m):
                        np.take(table[j], some[:, j], axis=0, out=held, mode="clip")
                        sums += held
                return out
            top.score(ids, scores, second(batch))
        return top, feed
    return _scan(queries, codes, books.shape[0] * books.shape[1], depth, best, search)


def _with_exact(queries: DataFrame, corpus: DataFrame):
    """Both with their vectors twice: ``embedding``, and ``exact`` (queries) or ``vector`` (corpus) for the exact products."""
    return (queries.select("id", "embedding", F.col("embedding").alias("exact")),
            corpus.select("id", "embedding", F.col("embedding").alias("vector")))


def pq_search(queries: DataFrame, corpus: DataFrame, k: int = 10, m: int = 16, n_centroids: int = 32, rounds: int = 8,
              depth: int = 100, exclude_self: bool = False) -> DataFrame:
    """Product quantisation: ``depth`` candidates by lookup tables over byte codes, ranked by their exact products."""
    books = kmeans(corpus, n_centroids, rounds, m)
    q, c = _with_exact(queries, corpus)
    return pq_scan(q, pq_codes(c, books), books, depth, exclude_self, k)


# -- PCA (#52-#54) ------------------------------------------------------------

def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance) from one pass of partial sums."""
    def partial(batches):
        n, total, square = 0, None, None
        for batch in _steps(batches):
            x = matrix(batch.column(0))
            n += len(x)
            total = x.sum(axis=0) + (0 if total is None else total)
            square = x.T @ x + (0 if square is None else square)
        if n:
            d = len(total)
            i, j = np.indices((d, d)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([i, np.arange(d), [-1]]), pa.int32()), pa.array(np.concatenate([j, np.full(d + 1, -1)]), pa.int32()),
                pa.array(np.concatenate([square.ravel(), total, [float(n)]]))], names=["i", "j", "x"])

    sums = (vectors.select("embedding").mapInArrow(partial, "i int, j int, x double").groupBy("i", "j")
            .agg(F.sum("x").alias("x")).toArrow())  # bounded: dim * dim + dim + 1 rows
    i, j, x = (sums.column(c).to_numpy() for c in range(3))
    if not len(x):
        raise ValueError("PCA needs at least one vector")
    n, d = int(x[i < 0][0]), int(i.max()) + 1
    mean, square = np.zeros(d), np.zeros((d, d))
    first = (i >= 0) & (j < 0)
    mean[i[first]] = x[first] / n
    square[i[j >= 0], j[j >= 0]] = x[j >= 0] / n
    return n, mean, square - np.outer(mean, mean)


def start_vector(component: int, dim: int) -> np.ndarray:
    """Fixed start of a component's iteration."""
    return np.array([float((i * 31 + component * 17) % 97 + 1) for i in range(dim)])


def pca_fit(vectors: DataFrame, k: int = 16, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(components (k, dim), share of the variance of each) by ``rounds`` power iterations a component, each kept
    orthogonal to the earlier ones.  Fewer directions of variance than ``k`` give fewer components."""
    _, _, cov = moments(vectors)
    found: list[np.ndarray] = []
    for t in range(min(k, len(cov))):
        v = start_vector(t, len(cov))
        for _ in range(rounds):
            w = cov @ v
            if found:
                w = w - np.array(found).T @ (np.array(found) @ w)
            norm = np.sqrt(w @ w)
            if norm < 1e-12:
                return np.array(found).reshape(len(found), len(cov)), _shares(found, cov)
            v = w / norm
        found.append(v)
    return np.array(found), _shares(found, cov)


def _shares(found, cov) -> np.ndarray:
    total = np.trace(cov)
    return np.array([v @ cov @ v / total if total > 0 else 0.0 for v in found])


def pca_project(components: np.ndarray, vectors: DataFrame) -> DataFrame:
    """(id, embedding, other columns): the vectors in the components' coordinates."""
    others = [f for f in vectors.schema.fields if f.name not in ("id", "embedding")]
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("embedding", T.ArrayType(T.DoubleType())), *others])
    shared = vectors.sparkSession.sparkContext.broadcast(components)

    def project(batches):
        for batch in _steps(batches):
            y = matrix(batch.column(1)) @ shared.value.T
            offsets = pa.array(np.arange(batch.num_rows + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel())), *batch.columns[2:]],
                                             names=schema.names)
    return vectors.select("id", "embedding", *[f.name for f in others]).mapInArrow(project, schema)


def pca_search(queries: DataFrame, corpus: DataFrame, k: int = 10, n_components: int = 32, rounds: int = 20, depth: int = 200,
               exclude_self: bool = False) -> DataFrame:
    """``depth`` candidates by the products of the projections (exhaustive), ranked by their exact products."""
    components, _ = pca_fit(corpus, n_components, rounds)
    q, c = _with_exact(queries, corpus)

    def search(columns):
        top, second = _top(columns, matrix(columns["exact"]) @ components.T, depth, exclude_self, k)
        return top, lambda ids, batch: top.add(ids, matrix(batch["vector"]) @ components.T, second(batch))
    return _scan(q.select("id", "exact"), c.select("id", "vector"), components.shape[1], depth, k, search)


def pca_pq_search(queries: DataFrame, corpus: DataFrame, k: int = 10, n_components: int = 32, pca_rounds: int = 20, m: int = 16,
                  n_centroids: int = 32, rounds: int = 8, depth: int = 300, exclude_self: bool = False) -> DataFrame:
    """Product quantisation of the projections: ``depth`` candidates by lookup tables, ranked by their exact products."""
    components, _ = pca_fit(corpus, n_components, pca_rounds)
    q, c = (pca_project(components, x) for x in _with_exact(queries, corpus))
    books = kmeans(c.select("id", "embedding"), n_centroids, rounds, m)
    return pq_scan(q, pq_codes(c, books), books, depth, exclude_self, k)
