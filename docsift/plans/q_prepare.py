"""Registered queries for sources, preparation and text operators (#1-#39)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.functions import text as TX
from docsift.operators import prepare as P
from docsift.plans import oracle as O
from docsift.plans.catalog import fx1, fx1_bm25_run, fx2, register, FX1_BM25
from docsift.session import scratch_path, spread
from docsift.sources import tables as S

W = O.with_
THR = P.split_threshold(C.TRAIN_FRACTION)
SPLIT_SQL = f"CASE WHEN substr(md5(concat('{C.SPLIT_SEED}:', CAST(query_id AS VARCHAR))), 1, 8) < '{THR}' THEN 'train' ELSE 'test' END"
FX2_SPLIT = f"fx2_split AS (SELECT query_id, {SPLIT_SQL} AS split FROM fx2_queries)"


def _split(spark, sf_dir):
    return P.split_queries(fx2(spark, sf_dir).queries).select("query_id", "split")


def _parts(queries, qrels, corpus):
    """The three tables of a dataset as rows of one: part, id, other_id, text."""
    none, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def rows(part, df, id_col, other, text):
        return df.select(F.lit(part).alias("part"), F.col(id_col).cast("bigint").alias("id"), other.alias("other_id"), text.alias("text"))

    return (rows("queries", queries, "query_id", none, F.col("text"))
            .unionByName(rows("qrels", qrels, "query_id", F.col("doc_id").cast("bigint"), no_text))
            .unionByName(rows("corpus", corpus, "doc_id", none, F.col("text"))))


def _parts_sql(queries, qrels, corpus, text="text", lead=""):
    return f"""SELECT {lead}'queries' AS part, CAST(query_id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS other_id, {text} AS text FROM {queries}
UNION ALL SELECT {lead}'qrels', CAST(query_id AS BIGINT), CAST(doc_id AS BIGINT), NULL FROM {qrels}
UNION ALL SELECT {lead}'corpus', CAST(doc_id AS BIGINT), NULL, {text} FROM {corpus}"""


# -- sources (#1-#11) ---------------------------------------------------------

@register("load_tables", sql="""
SELECT 'documents' AS part, CAST(doc_id AS BIGINT) AS id, text, lang AS tag FROM documents
UNION ALL SELECT 'benchmark', CAST(item_id AS BIGINT), text, NULL FROM benchmark
UNION ALL SELECT 'embeddings', CAST(vec_id AS BIGINT), NULL, CAST(label AS VARCHAR) FROM embeddings""")
def q_load_tables(spark, sf_dir):
    """#1 scans of the three tables: corpus, queries and labelled vectors."""
    t = S.load_tables(spark, sf_dir)

    def rows(part, id_col, text, tag):
        return t[part].select(F.lit(part).alias("part"), F.col(id_col).cast("bigint").alias("id"), text.cast("string").alias("text"),
                              tag.cast("string").alias("tag"))

    return (rows("documents", "doc_id", F.col("text"), F.col("lang")).unionByName(rows("benchmark", "item_id", F.col("text"), F.lit(None)))
            .unionByName(rows("embeddings", "vec_id", F.lit(None), F.col("label"))))


@register("load_beir_folder", sql=W(O.FX2) + """
SELECT 'corpus' AS part, CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS other_id, text, CAST(NULL AS BIGINT) AS relevance FROM fx2_corpus
UNION ALL SELECT 'queries', CAST(query_id AS VARCHAR), NULL, text, NULL FROM fx2_queries
UNION ALL SELECT 'qrels', CAST(query_id AS VARCHAR), CAST(doc_id AS VARCHAR), NULL, CAST(relevance AS BIGINT) FROM fx2_qrels""")
def q_load_beir_folder(spark, sf_dir):
    """#2 write FX-2 as a BEIR folder (jsonl + tsv) under the checkpoint dir and read it back."""
    d = fx2(spark, sf_dir)
    path = S.write_beir_folder(d.corpus, d.queries, d.qrels, scratch_path(spark, "beir"))
    c, q, r = S.load_beir_folder(spark, path)
    return (c.select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("other_id"),
                     "text", F.lit(None).cast("bigint").alias("relevance"))
            .unionByName(q.select(F.lit("queries").alias("part"), F.col("query_id").alias("id"),
                                  F.lit(None).cast("string").alias("other_id"), "text", F.lit(None).cast("bigint").alias("relevance")))
            .unionByName(r.select(F.lit("qrels").alias("part"), F.col("query_id").alias("id"), F.col("doc_id").alias("other_id"),
                                  F.lit(None).cast("string").alias("text"), F.col("relevance").cast("bigint"))))


def _corpus_s(spark, sf_dir):
    docs = S.load_table(spark, sf_dir, "documents").select("*", F.col("_metadata.row_index").alias("_row"))
    return P.build_corpus(docs, id_col="doc_id", text_col="text", order_col="_row", language_col="lang")


@register("build_corpus", sql="SELECT CAST(doc_id AS VARCHAR) AS doc_id, '' AS title, text, lang AS language FROM documents")
def q_build_corpus(spark, sf_dir):
    """#3 corpus builder: string ids, empty title, last row per id wins (parquet row index order)."""
    return _corpus_s(spark, sf_dir)


QRELS_S = """qrels_s AS (SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id,
                    max(language) AS language, 1 AS relevance
             FROM fx2_qrels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2)"""


@register("build_qrels", sql=W(O.FX2, QRELS_S) + "SELECT query_id, doc_id, language, CAST(relevance AS BIGINT) AS relevance FROM qrels_s")
def q_build_qrels(spark, sf_dir):
    """#4 qrels builder: judged doc must exist, distinct (query, doc), relevance 1."""
    d = fx2(spark, sf_dir)
    return P.build_qrels(d.qrels, _corpus_s(spark, sf_dir), query_col="query_id", doc_col="doc_id", language_col="language")


@register("build_queries", sql=W(O.FX2, QRELS_S) + """
SELECT CAST(query_id AS VARCHAR) AS query_id, text, language FROM fx2_queries
WHERE CAST(query_id AS VARCHAR) IN (SELECT query_id FROM qrels_s)""")
def q_build_queries(spark, sf_dir):
    """#5 query builder: queries with at least one judgment."""
    d = fx2(spark, sf_dir)
    qr = P.build_qrels(d.qrels, _corpus_s(spark, sf_dir), query_col="query_id", doc_col="doc_id", language_col="language")
    return P.build_queries(d.queries, qr, id_col="query_id")


@register("build_dataset_joint", sql=W(O.FX2, """
j_qr AS (SELECT * FROM fx2_qrels WHERE query_id IN (SELECT query_id FROM fx2_queries)),
j_q AS (SELECT * FROM fx2_queries WHERE query_id IN (SELECT query_id FROM j_qr))""")
          + _parts_sql("j_q", "j_qr", "fx2_corpus") + """
UNION ALL SELECT 'size of corpus', count(DISTINCT doc_id), NULL, NULL FROM fx2_corpus
UNION ALL SELECT 'size of queries_before', count(DISTINCT query_id), NULL, NULL FROM fx2_queries
UNION ALL SELECT 'size of qrels_queries', count(DISTINCT query_id), NULL, NULL FROM j_qr
UNION ALL SELECT 'size of queries', count(DISTINCT query_id), NULL, NULL FROM j_q""")
def q_build_dataset_joint(spark, sf_dir):
    """#6 joint builder: the three tables after the mutual query/qrels filter, and the sizes it reports."""
    d = fx2(spark, sf_dir)
    q, r, c, sizes = P.build_dataset_joint(d.queries, d.qrels, d.corpus)
    return _parts(q, r, c).unionByName(sizes.select(
        F.concat(F.lit("size of "), "part").alias("part"), F.col("n").alias("id"),
        F.lit(None).cast("bigint").alias("other_id"), F.lit(None).cast("string").alias("text")))


LANGUAGES = ("de", "en", "es", "fr")


@register("concat_languages", sql=W(O.FX2) + "\nUNION ALL ".join(
    f"SELECT query_id, text, language FROM fx2_queries WHERE language = '{x}'" for x in LANGUAGES))
def q_concat_languages(spark, sf_dir):
    """#9 concatenation of all per-language slices (bag union)."""
    q = fx2(spark, sf_dir).queries
    return P.concat_languages(*[P.filter_language(q, lang) for lang in LANGUAGES])


@register("assemble_dataset", sql=W(O.FX2, f"""
a_q AS (SELECT * FROM fx2_queries WHERE language IN {LANGUAGES}),
a_r AS (SELECT * FROM fx2_qrels WHERE language IN {LANGUAGES}),
a_c AS (SELECT * FROM fx2_corpus WHERE language IN {LANGUAGES}),
a_qr AS (SELECT DISTINCT query_id, doc_id FROM a_r WHERE doc_id IN (SELECT doc_id FROM a_c)),
a_qq AS (SELECT * FROM a_q WHERE query_id IN (SELECT query_id FROM a_qr))""") + _parts_sql("a_qq", "a_qr", "a_c"))
def q_assemble_dataset(spark, sf_dir):
    """#10 assembly of all concatenated slices into (queries, qrels, corpus)."""
    d = fx2(spark, sf_dir)
    q, r, c = (P.concat_languages(*[P.filter_language(df, x) for x in LANGUAGES]) for df in (d.queries, d.qrels, d.corpus))
    qr = P.build_qrels(r, c.withColumn("doc_id", F.col("doc_id").cast("string")), query_col="query_id", doc_col="doc_id")
    return _parts(P.build_queries(q, qr, id_col="query_id"), qr, c)


SUBSET_CTES = """
w AS (SELECT DISTINCT query_id FROM fx2_qrels ORDER BY query_id LIMIT 101),
j AS (SELECT r.query_id, r.doc_id, coalesce(length(c.text), 0) > 10 AS is_long
      FROM fx2_qrels r JOIN w ON r.query_id = w.query_id LEFT JOIN fx2_corpus c ON r.doc_id = c.doc_id),
keep AS (SELECT query_id FROM j GROUP BY query_id HAVING arg_max(is_long, doc_id))"""


@register("create_dataset", sql=W(O.FX2, SUBSET_CTES, """
de_q AS (SELECT * FROM fx2_queries WHERE language = 'de'), de_r AS (SELECT * FROM fx2_qrels WHERE language = 'de'),
de_c AS (SELECT * FROM fx2_corpus WHERE language = 'de'),
su_q AS (SELECT * FROM fx2_queries WHERE query_id IN (SELECT query_id FROM keep)),
su_r AS (SELECT * FROM j WHERE query_id IN (SELECT query_id FROM keep)),
su_c AS (SELECT * FROM fx2_corpus WHERE doc_id IN (SELECT doc_id FROM j WHERE is_long))""") + "\nUNION ALL ".join((
    _parts_sql("de_q", "de_r", "de_c", O.remove_stopwords("text", "german"), "'de without stopwords' AS branch, "),
    _parts_sql("fx2_queries", "fx2_qrels", "fx2_corpus", lead="'mixed' AS branch, "),
    _parts_sql("su_q", "su_r", "su_c", lead="'mixed subset' AS branch, "))))
def q_create_dataset(spark, sf_dir):
    """#11 dataset factory on FX-2: German slice without stopwords, everything as it is, and the length-aware subset."""
    d = fx2(spark, sf_dir)
    branches = {"de without stopwords": ("de", "german", True, False), "mixed": ("mixed", None, False, False),
                "mixed subset": ("mixed", None, False, True)}
    out = [_parts(*P.create_dataset(d.queries, d.qrels, d.corpus, *args)).withColumn("branch", F.lit(name))
           for name, args in branches.items()]
    return P.concat_languages(*out)


# -- filters and projections (#12-#18) -------------------------------------------

@register("filter_language", sql=W(O.FX2) + "SELECT query_id, doc_id, language, CAST(relevance AS BIGINT) AS relevance FROM fx2_qrels WHERE language = 'de'")
def q_filter_language(spark, sf_dir):
    """#12 language filter on qrels (pushed to the scan where the column is stored)."""
    return P.filter_language(fx2(spark, sf_dir).qrels, "de")


@register("slice_by_language", sql=W(O.FX2) + """
SELECT 'queries' AS part, language, query_id, CAST(NULL AS BIGINT) AS doc_id FROM fx2_queries
UNION ALL SELECT 'qrels', language, query_id, doc_id FROM fx2_qrels
UNION ALL SELECT 'corpus', language, NULL, doc_id FROM fx2_corpus""")
def q_slice_by_language(spark, sf_dir):
    """#13 per-language slices of the three tables, kept as a column."""
    d = fx2(spark, sf_dir)
    none = F.lit(None).cast("bigint")
    return (d.queries.select(F.lit("queries").alias("part"), "language", "query_id", none.alias("doc_id"))
            .unionByName(d.qrels.select(F.lit("qrels").alias("part"), "language", "query_id", "doc_id"))
            .unionByName(d.corpus.select(F.lit("corpus").alias("part"), "language", none.alias("query_id"), "doc_id")))


@register("filter_data", sql=W(O.FX2, *[f"f_{t} AS (SELECT * FROM fx2_{t} WHERE language = 'en')" for t in ("queries", "qrels", "corpus")])
          + _parts_sql("f_queries", "f_qrels", "f_corpus"))
def q_filter_data(spark, sf_dir):
    """#14 three-table slice on one language."""
    d = fx2(spark, sf_dir)
    return _parts(*P.filter_data(d.queries, d.qrels, d.corpus, "en"))


@register("filter_short_queries", sql=W(O.FX2) + "SELECT query_id, coalesce(length(text), 0) <= 3 AS is_short FROM fx2_queries")
def q_filter_short_queries(spark, sf_dir):
    """#15 min-length predicate, both sides kept (flag)."""
    return P.split_short(fx2(spark, sf_dir).queries).select("query_id", "is_short")


@register("shorten_text", sql=W(O.FX2) + "SELECT query_id, substring(text, 1, 500) AS text FROM fx2_queries")
def q_shorten_text(spark, sf_dir):
    """#16 truncate query text to 500 characters (the operator's purpose)."""
    return fx2(spark, sf_dir).queries.select("query_id", TX.shorten("text", 500).alias("text"))


@register("doc_full_text", sql=W(O.FX2) + "SELECT doc_id, concat(coalesce(title, ''), ' ', coalesce(text, '')) AS full_text FROM fx2_corpus")
def q_doc_full_text(spark, sf_dir):
    """#17 title + ' ' + text."""
    return fx2(spark, sf_dir).corpus.select("doc_id", TX.full_text("title", "text").alias("full_text"))


@register("doc_sep_text", sql=W(O.FX2) + f"SELECT doc_id, concat(coalesce(title, ''), '{C.SEP_TOKEN}', coalesce(text, '')) AS sep_text FROM fx2_corpus")
def q_doc_sep_text(spark, sf_dir):
    """#18 title [SEP] text."""
    return fx2(spark, sf_dir).corpus.select("doc_id", TX.sep_text("title", "text").alias("sep_text"))


# -- joins (#19-#27) -------------------------------------------------------------

@register("ssl_queries", sql=W(O.FX2, FX2_SPLIT) + """
SELECT query_id FROM fx2_split WHERE split = 'test'
AND query_id IN (SELECT query_id FROM fx2_qrels WHERE language = 'de')""")
def q_ssl_queries(spark, sf_dir):
    """#19 single-language-link queries: test queries present in the 'de' qrels."""
    test = _split(spark, sf_dir).where("split = 'test'")
    ssl = P.filter_language(fx2(spark, sf_dir).qrels, "de")
    return P.semi(test.select("query_id"), ssl)


@register("qrels_for_queries", sql=W(O.FX2, FX2_SPLIT) + """
SELECT query_id, doc_id FROM fx2_qrels WHERE query_id IN (SELECT query_id FROM fx2_split WHERE split = 'train')""")
def q_qrels_for_queries(spark, sf_dir):
    """#20 qrels restricted to the train queries."""
    return P.semi(fx2(spark, sf_dir).qrels, _split(spark, sf_dir).where("split = 'train'")).select("query_id", "doc_id")


@register("create_sll", sql=W(O.FX2, """
s_r AS (SELECT query_id, doc_id FROM fx2_qrels WHERE language = 'de'
        AND query_id IN (SELECT query_id FROM fx2_queries) AND doc_id IN (SELECT doc_id FROM fx2_corpus))""") + """
SELECT 'qrels' AS part, query_id, doc_id FROM s_r
UNION ALL SELECT 'queries', query_id, NULL FROM fx2_queries WHERE query_id IN (SELECT query_id FROM s_r)""")
def q_create_sll(spark, sf_dir):
    """#21 single-language slice: judgments of one language whose query and doc exist, plus their queries."""
    d = fx2(spark, sf_dir)
    r = P.filter_language(d.qrels, "de").join(d.queries.select("query_id"), "query_id", "left_semi") \
        .join(d.corpus.select("doc_id"), "doc_id", "left_semi")
    q = P.semi(d.queries, r)
    return (r.select(F.lit("qrels").alias("part"), "query_id", "doc_id")
            .unionByName(q.select(F.lit("queries").alias("part"), "query_id", F.lit(None).cast("bigint").alias("doc_id"))))


MERGE_ORDER = ("de", "en", "es", "fr", "mixed")


@register("merge_qrels_right_wins", sql=W(O.FX2, "m AS (" + " UNION ALL ".join(
    f"SELECT query_id, doc_id, language, {i} AS prio FROM fx2_qrels WHERE language = '{x}'" for i, x in enumerate(MERGE_ORDER)) + ")") + """
SELECT query_id, doc_id, language FROM (SELECT *, max(prio) OVER (PARTITION BY query_id) AS mx FROM m) WHERE prio = mx""")
def q_merge_qrels_right_wins(spark, sf_dir):
    """#22 right-biased merge of per-language qrels (last input's set replaces earlier ones)."""
    r = fx2(spark, sf_dir).qrels
    return P.merge_qrels_right_wins(*[P.filter_language(r, x) for x in MERGE_ORDER]).select("query_id", "doc_id", "language")


@register("first_n_judged", sql=W(O.FX2) + """
SELECT query_id FROM fx2_queries WHERE query_id IN (SELECT query_id FROM fx2_qrels) ORDER BY query_id LIMIT 99""")
def q_first_n_judged(spark, sf_dir):
    """#23 first 99 judged queries by id (the reference's '100' subset)."""
    d = fx2(spark, sf_dir)
    return P.first_n_judged(d.queries, d.qrels, 99).select("query_id")


@register("closure_subset", sql=W(O.FX2, FX2_SPLIT, """
c_r AS (SELECT * FROM fx2_qrels WHERE query_id IN (SELECT query_id FROM fx2_split WHERE split = 'train'))""") + """
SELECT 'qrels' AS part, query_id AS id, doc_id AS other_id FROM c_r
UNION ALL SELECT 'corpus', doc_id, NULL FROM fx2_corpus WHERE doc_id IN (SELECT doc_id FROM c_r)""")
def q_closure_subset(spark, sf_dir):
    """#24 closure: qrels of the train queries and the corpus shrunk to their judged docs."""
    d = fx2(spark, sf_dir)
    _, r, c = P.closure_subset(_split(spark, sf_dir).where("split = 'train'"), d.qrels, d.corpus)
    return (r.select(F.lit("qrels").alias("part"), F.col("query_id").alias("id"), F.col("doc_id").alias("other_id"))
            .unionByName(c.select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("other_id"))))


@register("create_subset", sql=W(O.FX2, SUBSET_CTES) + """
SELECT 'queries' AS part, query_id AS id, CAST(NULL AS BIGINT) AS other_id FROM keep
UNION ALL SELECT 'qrels', query_id, doc_id FROM j WHERE query_id IN (SELECT query_id FROM keep)
UNION ALL SELECT 'corpus', doc_id, NULL FROM (SELECT DISTINCT doc_id FROM j WHERE is_long)
UNION ALL SELECT 'short', count(*), NULL FROM j WHERE NOT is_long""")
def q_create_subset(spark, sf_dir):
    """#25 length-aware subset of the first n+1 judged queries (n=100, rule='last')."""
    d = fx2(spark, sf_dir)
    q, r, c, short = P.create_subset(100, d.queries, d.qrels, d.corpus, rule="last")
    nul = F.lit(None).cast("bigint")
    return (q.select(F.lit("queries").alias("part"), F.col("query_id").alias("id"), nul.alias("other_id"))
            .unionByName(r.select(F.lit("qrels").alias("part"), F.col("query_id").alias("id"), F.col("doc_id").alias("other_id")))
            .unionByName(c.select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id"), nul.alias("other_id")))
            .unionByName(short.select(F.lit("short").alias("part"), F.col("short").alias("id"), nul.alias("other_id"))))


@register("split_audit", sql=W(O.FX2, FX2_SPLIT, """
a AS (SELECT s.query_id, s.split, s.query_id IN (SELECT query_id FROM fx2_qrels) AS judged FROM fx2_split s)""") + """
SELECT 'missing_corpus' AS metric, count(*) AS n FROM fx2_qrels r
 WHERE r.query_id IN (SELECT query_id FROM a WHERE judged) AND r.doc_id NOT IN (SELECT doc_id FROM fx2_corpus)
UNION ALL SELECT 'missing_qrel_' || split, count(*) FILTER (WHERE NOT judged) FROM a GROUP BY split
UNION ALL SELECT 'queries_' || split, count(*) FILTER (WHERE judged) FROM a GROUP BY split""")
def q_split_audit(spark, sf_dir):
    """#26 audit: judged docs missing from the corpus, queries without qrels per split, sizes."""
    d = fx2(spark, sf_dir)
    return P.split_audit(d.queries, d.qrels, d.corpus, _split(spark, sf_dir))


@register("hydrate_run", sql=W(O.FX1, FX1_BM25) + """
SELECT r.query_id, r.doc_id, CAST(r.rank AS BIGINT) AS rank, q.text AS query_text, c.text AS doc_text
FROM bm_run r JOIN fx1_queries q ON r.query_id = q.query_id JOIN fx1_corpus c ON r.doc_id = c.doc_id WHERE r.rank <= 10""")
def q_hydrate_run(spark, sf_dir):
    """#27 text hydration of the top-10 of the FX-1 BM25 run."""
    d = fx1(spark, sf_dir)
    run = P.run_topk(fx1_bm25_run(spark, sf_dir), 10)
    return P.hydrate_run(run, d.queries, d.corpus).select("query_id", "doc_id", "rank", "query_text", "doc_text")


# -- splits, sampling, ordering (#28-#33) ----------------------------------------

@register("split_queries", sql=W(O.FX2, FX2_SPLIT) + "SELECT query_id, split FROM fx2_split")
def q_split_queries(spark, sf_dir):
    """#28 seeded hash split 10 % train / 90 % test."""
    return _split(spark, sf_dir)


@register("split_ordered", sql=W(O.FX2, """
j AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS idx FROM fx2_queries
      WHERE query_id IN (SELECT query_id FROM fx2_qrels))""") + f"""
SELECT q.query_id, coalesce(CASE WHEN j.idx - 1 < {C.TRAIN_FRACTION!r} * (SELECT count(*) FROM fx2_queries) THEN 'train'
                                 WHEN j.idx IS NOT NULL THEN 'test' END, 'dropped') AS split
FROM fx2_queries q LEFT JOIN j ON q.query_id = j.query_id""")
def q_split_ordered(spark, sf_dir):
    """#29 ordered split: the first 10 % (of all queries) judged queries by id -> train."""
    d = fx2(spark, sf_dir)
    return P.split_ordered(d.queries, d.qrels, C.TRAIN_FRACTION)


@register("shuffle_seeded", sql=W(O.FX2) + "SELECT query_id, md5(concat('42:', CAST(query_id AS VARCHAR))) AS shuffle_key FROM fx2_queries")
def q_shuffle_seeded(spark, sf_dir):
    """#30 seeded shuffle key (ordering by it is the shuffle)."""
    return P.shuffle_seeded(fx2(spark, sf_dir).queries, "query_id").select("query_id", "shuffle_key")


@register("sample_query", sql=W(O.FX1, FX1_BM25, """
pick AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM bm_run) ORDER BY md5(concat('42:', CAST(query_id AS VARCHAR))) LIMIT 1)""")
          + "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm_run WHERE query_id IN (SELECT query_id FROM pick)")
def q_sample_query(spark, sf_dir):
    """#31 one pseudo-randomly sampled query of the run (all its rows)."""
    return P.sample_query(fx1_bm25_run(spark, sf_dir))


@register("top_docs", sql=W(O.FX1, FX1_BM25) + """
SELECT r.query_id, CAST(r.rank AS BIGINT) AS rank, r.doc_id, r.score, c.title, c.text
FROM bm_run r JOIN fx1_corpus c ON r.doc_id = c.doc_id WHERE r.rank <= 10""")
def q_top_docs(spark, sf_dir):
    """#32 top-10 display table per query (id, title, text)."""
    d = fx1(spark, sf_dir)
    return P.top_docs(fx1_bm25_run(spark, sf_dir), d.corpus, 10)


@register("run_topk", sql=W(O.FX1, FX1_BM25) + "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm_run WHERE rank <= 10")
def q_run_topk(spark, sf_dir):
    """#33 run cut to k=10 per query."""
    return P.run_topk(fx1_bm25_run(spark, sf_dir), 10)


# -- text functions (#34-#39) ------------------------------------------------------

def _docs(spark, sf_dir):
    """Document scan spread over the cores before per-row regex work (no-op for split inputs)."""
    return spread(S.load_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("normalize_text", sql=f"SELECT doc_id, {O.normalize('text')} AS normalized FROM documents")
def q_normalize_text(spark, sf_dir):
    """#34 Unicode-aware non-word normalisation."""
    return _docs(spark, sf_dir).select("doc_id", TX.normalize_text("text").alias("normalized"))


@register("tokenize", sql=f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {O.tokenize('text')} AS t FROM documents)")
def q_tokenize(spark, sf_dir):
    """#35 lower-case + split into tokens (count and the space-joined token stream)."""
    t = _docs(spark, sf_dir).select("doc_id", TX.tokenize("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("remove_stopwords", sql=f"SELECT doc_id, {O.remove_stopwords('text', 'german')} AS text FROM documents")
def q_remove_stopwords(spark, sf_dir):
    """#36 German stopword removal, case preserved."""
    return _docs(spark, sf_dir).select("doc_id", TX.remove_stopwords("text", "german").alias("text"))


MULTI = ("german", "french", "italian")


@register("remove_stopwords_multi", sql=f"SELECT doc_id, {O.remove_stopwords('text', MULTI)} AS text FROM documents")
def q_remove_stopwords_multi(spark, sf_dir):
    """#37 cumulative German+French+Italian stopword removal."""
    return _docs(spark, sf_dir).select("doc_id", TX.remove_stopwords("text", MULTI).alias("text"))


@register("shorten_and_reduce", sql=f"SELECT doc_id, substring({O.remove_stopwords('text', 'german')}, 1, 500) AS text FROM documents")
def q_shorten_and_reduce(spark, sf_dir):
    """#38 stopword removal then truncation to 500 characters."""
    return _docs(spark, sf_dir).select(
        "doc_id", TX.shorten(TX.remove_stopwords("text", "german"), 500).alias("text"))


def _analyzer_case_sql():
    parts = " ".join(f"WHEN lang = '{code}' THEN array_to_string({O.analyze('text', name)}, ' ')"
                     for code, name in C.LANGUAGE_ANALYZER.items())
    return f"CASE {parts} END"


@register("analyze_language", sql=f"SELECT doc_id, {_analyzer_case_sql()} AS terms FROM documents")
def q_analyze_language(spark, sf_dir):
    """#39 per-document language analyzer (lower, stopwords, light stemming)."""
    docs = spread(S.load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    expr = None
    for code, name in C.LANGUAGE_ANALYZER.items():
        branch = F.array_join(TX.analyze("text", name), " ")
        expr = F.when(F.col("lang") == code, branch) if expr is None else expr.when(F.col("lang") == code, branch)
    return docs.select("doc_id", expr.alias("terms"))
