"""Registered queries for retrieval, vectors and reranking (#8, #42-#56)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions.text import full_text
from docsift.operators import dense as D
from docsift.operators import lexical as L
from docsift.operators import quantise as Q
from docsift.operators import rerank as R
from docsift.operators import training as TR
from docsift.operators.lexical_store import LexicalStore, open_or_create
from docsift.plans import oracle as O
from docsift.plans.catalog import _cached, fx1, fx1_bm25_run, fx1_index, register, FX1_BM25
from docsift.session import scratch_path, stored
from docsift.sources import fixtures as FX
from docsift.sources import tables as S

W = O.with_
HASH_DIM = 256
DENSE_K = 10


def fx3(spark, sf_dir):
    return _cached(spark, ("fx3", sf_dir), lambda: FX.fx3_vectors(spark, sf_dir).select("id", "embedding"))


# -- lexical (#8, #42, #43) -------------------------------------------------------

@register("index_save_load", sql=W(O.FX1, O.bm25_ctes("bm", "fx1_corpus", "fx1_queries"))
          + "SELECT term, doc_id, tf FROM bm_p")
def q_index_save_load(spark, sf_dir):
    """#8 index artefact: a stored index is published at ``{prefix}.{ext}`` the first time and loaded from then on;
    its postings."""
    path = _cached(spark, ("store", sf_dir), lambda: S.index_path(scratch_path(spark, "index"), "fx1", "bm25"))
    open_or_create(spark, path, lambda: fx1(spark, sf_dir).corpus)
    store, _ = open_or_create(spark, path, lambda: fx1(spark, sf_dir).corpus)  # published by now: loaded
    return store.read().postings.select("term", "doc_id", "tf")


@register("bm25_index_update", sql=W(O.FX1, O.bm25_ctes("bm", "fx1_corpus", "fx1_queries"))
          + "SELECT p.term, p.doc_id, p.tf, p.dl, t.df, round(t.idf, 6) AS idf FROM bm_p p JOIN bm_t t ON p.term = t.term")
def q_bm25_index_update(spark, sf_dir):
    """#40 index maintenance: all documents indexed, those of one language deleted and then appended again; the merged
    postings with their document frequency and idf equal those of a rebuild."""
    corpus = fx1(spark, sf_dir).corpus
    german = corpus.where(F.col("language") == "de")
    store = LexicalStore(spark, scratch_path(spark, "index-update")).create(corpus)
    index = store.delete(german.select("doc_id")).append(german).read(storage=None)
    return (index.postings.join(index.terms.select("term", "df", "idf"), "term")
            .select("term", "doc_id", "tf", "dl", "df", F.round("idf", 6).alias("idf")))


FX1_BM25_EN = O.bm25_ctes("be", "fx1_corpus", "fx1_queries", analyzer="english") + "," + O.topk_cte("be_run", "be_scored", C.TOP_K)


def fx1_lang_run(spark, sf_dir):
    """BM25 run with the English analyzer over FX-1, persisted for reuse (#42, #67)."""
    return _cached(spark, ("fx1_lang_run", sf_dir), lambda: L.bm25_search(
        fx1_index(spark, sf_dir, analyzer="english"), fx1(spark, sf_dir).queries).persist(StorageLevel.MEMORY_AND_DISK))


@register("bm25_search_lang", sql=W(O.FX1, FX1_BM25_EN) + O.run_select("be_run"))
def q_bm25_search_lang(spark, sf_dir):
    """#42 BM25 with the English analyzer (stopwords + light stemming) on both sides."""
    return fx1_lang_run(spark, sf_dir)


POS_DOCS_SQL = "pd AS (SELECT DISTINCT q.doc_id AS query_id, concat(c.title, ' ', c.text) AS text FROM fx1_qrels q JOIN fx1_corpus c ON q.doc_id = c.doc_id WHERE q.relevance > 0)"
MULTI_SQL = (O.bm25_ctes("bm", "fx1_corpus", "pd") + "," + O.topk_cte("bm_hits", "bm_scored", C.BM25_HARD_NEGATIVE_HITS))


@register("bm25_multisearch_docs", sql=W(O.FX1, POS_DOCS_SQL, MULTI_SQL) + O.run_select("bm_hits"))
def q_bm25_multisearch_docs(spark, sf_dir):
    """#43 batched multi-search: every judged document's full text as a query, top 11."""
    d = fx1(spark, sf_dir)
    docs = (stored(TR.positive_docs(d.qrels).select("doc_id").distinct(), "positive-ids")
            .join(d.corpus.select("doc_id", full_text("title", "text").alias("full_text")), "doc_id"))
    return L.bm25_multisearch_docs(fx1_index(spark, sf_dir), docs)


# -- encoders (#44, #45) ----------------------------------------------------------

@register("encode_hashed_tfidf", sql=W(O.hashed_tfidf_ctes("h", "documents", HASH_DIM))
          + "SELECT id AS doc_id, dim, round(w, 6) + CAST(0 AS DOUBLE) AS w FROM h_dv")
def q_encode_hashed_tfidf(spark, sf_dir):
    """#44 signed hashed TF-IDF document vectors (256 dims, sparse rows)."""
    docs = S.load_table(spark, sf_dir, "documents")
    # the FX-1 index was built over the same documents with the same tokenizer: reuse its postings
    v = D.encode_hashed_tfidf(docs, HASH_DIM, index=fx1_index(spark, sf_dir))
    return v.select(F.col("id").alias("doc_id"), "dim", (F.round("w", 6) + F.lit(0.0)).alias("w"))


def fx1_towers(spark, sf_dir):
    d = fx1(spark, sf_dir)
    return _cached(spark, ("towers", sf_dir),
                   lambda: D.encode_two_tower(d.queries, d.corpus, HASH_DIM, index=fx1_index(spark, sf_dir)))


TOWERS_SQL = O.hashed_tfidf_ctes("h", "fx1_corpus", HASH_DIM, queries="fx1_queries")


@register("encode_two_tower", sql=W(O.FX1, TOWERS_SQL) + """
SELECT 'query' AS tower, id, dim, round(w, 6) + CAST(0 AS DOUBLE) AS w FROM h_qv
UNION ALL SELECT 'document', id, dim, round(w, 6) + CAST(0 AS DOUBLE) FROM h_dv""")
def q_encode_two_tower(spark, sf_dir):
    """#45 query tower (binary * idf) and document tower ((1 + ln tf) * idf) over the corpus idf."""
    qv, dv = fx1_towers(spark, sf_dir)
    out = qv.withColumn("tower", F.lit("query")).unionByName(dv.withColumn("tower", F.lit("document")))
    return out.select("tower", "id", "dim", (F.round("w", 6) + F.lit(0.0)).alias("w"))


# -- exact dense search (#46-#48) ---------------------------------------------------

def _dense_sql(metric):
    return (W(O.FX3, O.dot_scored_cte("ds", "fx3_vectors", "fx3_vectors", metric),
              O.topk_cte("dr", "ds", DENSE_K, exclude_self=True)) + O.run_select("dr"))


@register("dense_search_dot", sql=_dense_sql("dot"))
def q_dense_search_dot(spark, sf_dir):
    """#46 exact inner-product top-10, every embedding as a query (self excluded)."""
    v = fx3(spark, sf_dir)
    return D.dense_search(v, v, DENSE_K, "dot", exclude_self=True)


@register("dense_search_cosine", sql=_dense_sql("cos"))
def q_dense_search_cosine(spark, sf_dir):
    """#47 exact cosine top-10."""
    v = fx3(spark, sf_dir)
    return D.dense_search(v, v, DENSE_K, "cos", exclude_self=True)


@register("flat_ip_search", sql=_dense_sql("dot"))
def q_flat_ip_search(spark, sf_dir):
    """#48 flat inner-product index: vectors persisted as an index artefact, then exact search."""
    v = fx3(spark, sf_dir)
    base = scratch_path(spark, "index")
    S.save_or_load_index(spark, lambda: v, base, "fx3", "flat")
    idx = S.save_or_load_index(spark, lambda: v, base, "fx3", "flat")  # found complete: read, not built
    return D.dense_search(v, idx, DENSE_K, "dot", exclude_self=True)


# -- approximate / compressed (#49-#54) -------------------------------------------------

DIM = 64
#: Inverted file: lists, probed lists, Lloyd rounds.  Recall@10 against #46 over the whole table is 0.95 at sf0.01 and 0.94
#: at sf0.1 with 69 % of all pairs scored: these vectors have no structure, so near ones lie in many cells.
IVF_LISTS, IVF_PROBES, IVF_ROUNDS = 32, 22, 5
#: Product quantisation: parts, centres, Lloyd rounds, depth of the exact rank (recall@10 0.99 at sf0.01, 0.94 at sf0.1).
PQ_PARTS, PQ_CENTRES, PQ_ROUNDS, PQ_DEPTH = 16, 32, 8, 100
#: PCA: components, power iterations, depth of the exact rank; the compressed projections need a deeper one.
PCA_K, PCA_ROUNDS, PCA_DEPTH, PCA_PQ_DEPTH = 32, 20, 250, 300

IVF_SQL = W(O.FX3, "iv_x AS MATERIALIZED (SELECT id, 0 AS j, embedding AS x FROM fx3_vectors)",
            O.kmeans_ctes("iv", "iv_x", IVF_LISTS, IVF_ROUNDS, Q.FIT_ROWS), f"""
probe AS (SELECT id, c FROM (SELECT v.id, m.c, row_number() OVER (PARTITION BY v.id ORDER BY round(list_distance(v.x, m.x), 9), m.c) AS place
          FROM iv_x v, iv_c m) WHERE place <= {IVF_PROBES}),
cand AS (SELECT q.id AS query_id, a.id AS doc_id FROM probe q JOIN iv_a a ON q.c = a.c)""", O.exact_cte("ivs", "cand", "fx3_vectors"),
            O.topk_cte("ar", "ivs", DENSE_K, exclude_self=True)) + O.run_select("ar")


@register("ann_search", sql=IVF_SQL)
def q_ann_search(spark, sf_dir):
    """#50 approximate search by an inverted file: k-means lists, the nearest of which each query probes."""
    v = fx3(spark, sf_dir)
    return Q.ivf_search(v, v, DENSE_K, IVF_LISTS, IVF_PROBES, IVF_ROUNDS, exclude_self=True)


SQ_SQL = W(O.FX3, f"""
e AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM fx3_vectors),
mm AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e GROUP BY i),
code AS (SELECT e.id, e.i, CAST(CASE WHEN hi > lo THEN round((x - lo) / (hi - lo) * CAST(255 AS DOUBLE)) ELSE 0 END AS BIGINT) AS c FROM e JOIN mm USING (i)),
wt AS (SELECT id, i, x * ((hi - lo) / CAST(255 AS DOUBLE)) AS w, x * lo AS o FROM e JOIN mm USING (i)),
sc AS (SELECT id, max(abs(w)) / CAST({D.SQ_LEVELS} AS DOUBLE) AS scale, sum(o) AS base FROM wt GROUP BY id),
wi AS (SELECT id, i, CAST(floor(w / scale + CAST(0.5 AS DOUBLE)) AS BIGINT) AS w FROM wt JOIN sc USING (id)),
dots AS (SELECT q.id, d.id AS doc, sum(q.w * d.c) AS s FROM wi q JOIN code d ON q.i = d.i GROUP BY q.id, d.id),
sqs AS (SELECT id AS query_id, doc AS doc_id, base + scale * CAST(s AS DOUBLE) AS score FROM dots JOIN sc USING (id))""",
           O.topk_cte("sr", "sqs", DENSE_K, exclude_self=True)) + O.run_select("sr")


@register("sq_search", sql=SQ_SQL)
def q_sq_search(spark, sf_dir):
    """#51 scalar-quantised (8-bit per dimension) search by integer products with the codes."""
    v = fx3(spark, sf_dir)
    return D.sq_search(v, v, DENSE_K, exclude_self=True)


PQ_SQL = W(O.FX3, O.pq_ctes("pq", "fx3_vectors", PQ_PARTS, DIM, PQ_CENTRES, PQ_ROUNDS, Q.FIT_ROWS, PQ_DEPTH),
           O.exact_cte("pqe", "pq_cand", "fx3_vectors"), O.topk_cte("pr", "pqe", DENSE_K)) + O.run_select("pr")


@register("pq_search", sql=PQ_SQL)
def q_pq_search(spark, sf_dir):
    """#49 product quantisation: 16 parts x 32 centres, lookup tables over byte codes, the best 100 ranked exactly."""
    v = fx3(spark, sf_dir)
    return Q.pq_search(v, v, DENSE_K, PQ_PARTS, PQ_CENTRES, PQ_ROUNDS, PQ_DEPTH, exclude_self=True)


PCA_CTES = O.pca_ctes("pc", "fx3_vectors", DIM, PCA_K, PCA_ROUNDS)


@register("pca_reduce", sql=W(O.FX3, PCA_CTES, f"""
pc_g AS (SELECT id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS component FROM pc_y)""") + """
SELECT id, CAST(component AS BIGINT) AS component, round(value, 6) + CAST(0 AS DOUBLE) AS value FROM pc_g""")
def q_pca_reduce(spark, sf_dir):
    """#52 PCA 64 -> 32 fitted on the corpus vectors; long rows (id, component, value)."""
    v = fx3(spark, sf_dir)
    out = Q.pca_project(Q.pca_fit(v, PCA_K, PCA_ROUNDS)[0], v)
    return (out.select("id", F.posexplode("embedding").alias("component", "value"))
            .withColumn("value", F.round("value", 6) + F.lit(0.0)))


@register("pca_search", sql=W(O.FX3, PCA_CTES, O.dot_scored_cte("pcs", "pc_y", "pc_y"),
                              O.topk_cte("pc_cand", "pcs", PCA_DEPTH, exclude_self=True),
                              O.exact_cte("pce", "pc_cand", "fx3_vectors"), O.topk_cte("pr", "pce", DENSE_K)) + O.run_select("pr"))
def q_pca_search(spark, sf_dir):
    """#53 the best 250 by inner product of PCA(32) projections, ranked exactly, top 10."""
    v = fx3(spark, sf_dir)
    return Q.pca_search(v, v, DENSE_K, PCA_K, PCA_ROUNDS, PCA_DEPTH, exclude_self=True)


@register("pca_pq_search", sql=W(O.FX3, PCA_CTES, O.pq_ctes("pq", "pc_y", PQ_PARTS, PCA_K, PQ_CENTRES, PQ_ROUNDS, Q.FIT_ROWS, PCA_PQ_DEPTH),
                                 O.exact_cte("pqe", "pq_cand", "fx3_vectors"), O.topk_cte("pr", "pqe", DENSE_K)) + O.run_select("pr"))
def q_pca_pq_search(spark, sf_dir):
    """#54 PCA(32), then product quantisation of the projections; the best 300 ranked exactly."""
    v = fx3(spark, sf_dir)
    return Q.pca_pq_search(v, v, DENSE_K, PCA_K, PCA_ROUNDS, PQ_PARTS, PQ_CENTRES, PQ_ROUNDS, PCA_PQ_DEPTH, exclude_self=True)


# -- reranking (#55, #56) --------------------------------------------------------------

def _bigram_sql(tok):
    return f"list_transform(range(1, len({tok})), lambda i: {tok}[i] || ' ' || {tok}[i + 1])"


RERANK_PAIRS_SQL = W(O.FX1, FX1_BM25, f"""
rq AS (SELECT DISTINCT q.query_id, q.term, t.idf FROM bm_qt q JOIN bm_t t ON q.term = t.term),
rtot AS (SELECT query_id, sum(idf) AS total FROM rq GROUP BY query_id),
rp AS (SELECT query_id, doc_id FROM bm_run WHERE rank <= 100),
rhit AS (SELECT p.query_id, p.doc_id, sum(q.idf) AS hit FROM rp p JOIN rq q ON p.query_id = q.query_id
         JOIN bm_p x ON x.term = q.term AND x.doc_id = p.doc_id GROUP BY p.query_id, p.doc_id),
rqt AS (SELECT query_id, {O.tokenize('text')} AS t FROM fx1_queries),
rqb AS (SELECT DISTINCT query_id, unnest({_bigram_sql('t')}) AS bg FROM rqt),
rdt AS (SELECT doc_id, {O.tokenize('text')} AS t FROM fx1_corpus WHERE doc_id IN (SELECT doc_id FROM rp)),
rdb AS (SELECT DISTINCT doc_id, unnest({_bigram_sql('t')}) AS bg FROM rdt),
rov AS (SELECT p.query_id, p.doc_id, count(*) AS overlap FROM rp p JOIN rqb q ON p.query_id = q.query_id
        JOIN rdb d ON d.doc_id = p.doc_id AND d.bg = q.bg GROUP BY p.query_id, p.doc_id),
rs AS (SELECT p.query_id, p.doc_id,
              coalesce(h.hit, CAST(0 AS DOUBLE)) / t.total * ({O.dbl(1.0)} + ln({O.dbl(1.0)} + coalesce(o.overlap, 0))) AS score
       FROM rp p LEFT JOIN rhit h ON p.query_id = h.query_id AND p.doc_id = h.doc_id
       LEFT JOIN rov o ON p.query_id = o.query_id AND p.doc_id = o.doc_id
       JOIN rtot t ON p.query_id = t.query_id)""",
                     O.topk_cte("rr", "rs", C.RERANK_DEPTH)) + O.run_select("rr")


@register("rerank_pairs", sql=RERANK_PAIRS_SQL)
def q_rerank_pairs(spark, sf_dir):
    """#55 BM25 top-100 re-scored by the default pair scorer: idf-weighted term coverage
    times (1 + ln(1 + bigram overlap))."""
    d = fx1(spark, sf_dir)
    return R.rerank_pairs(fx1_bm25_run(spark, sf_dir), d.queries, d.corpus, index=fx1_index(spark, sf_dir))


RERANK_DENSE_SQL = W(O.FX1, FX1_BM25, TOWERS_SQL, """
rp AS (SELECT query_id, doc_id FROM bm_run WHERE rank <= 100),
rd AS (SELECT p.query_id, p.doc_id, sum(q.w * d.w) AS score FROM rp p JOIN h_qv q ON p.query_id = q.id
       JOIN h_dv d ON d.id = p.doc_id AND d.dim = q.dim GROUP BY p.query_id, p.doc_id),
rs AS (SELECT p.query_id, p.doc_id, coalesce(r.score, CAST(0 AS DOUBLE)) AS score FROM rp p
       LEFT JOIN rd r ON p.query_id = r.query_id AND p.doc_id = r.doc_id)""",
                     O.topk_cte("rr", "rs", C.RERANK_DEPTH)) + O.run_select("rr")


@register("rerank_dense", sql=RERANK_DENSE_SQL)
def q_rerank_dense(spark, sf_dir):
    """#56 BM25 top-100 re-scored by the cosine of the two-tower hashed TF-IDF vectors."""
    d = fx1(spark, sf_dir)
    run = fx1_bm25_run(spark, sf_dir)
    cand = run.where(F.col("rank") <= C.RERANK_DEPTH).select(F.col("doc_id").alias("id"))
    qv, dv = D.encode_two_tower(d.queries, d.corpus, HASH_DIM, index=fx1_index(spark, sf_dir), doc_ids=cand)
    return R.rerank_dense(run, qv, dv)
