"""DuckDB SQL builders for the oracle check, generated from the same constants.

Every float literal is rendered as ``CAST('<repr>' AS DOUBLE)`` so DuckDB uses
the same IEEE double as Spark (a bare ``2.2`` would be a DECIMAL there).
"""

from __future__ import annotations

from docsift import constants as C


def dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def normalize(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '{C.NON_WORD_REGEX}', ' ', 'g')"


def split_tokens(expr: str) -> str:
    return f"list_filter(string_split(trim({expr}), ' '), lambda t: t <> '')"


def tokenize(expr: str) -> str:
    return split_tokens(normalize(f"lower({expr})"))


def stopword_filter(list_expr: str, words) -> str:
    return f"list_filter({list_expr}, lambda t: NOT list_contains({sql_list(words)}, lower(t)))"


def remove_stopwords(expr: str, languages) -> str:
    if isinstance(languages, str):
        languages = [languages]
    words = C.stopwords_union(languages)
    return f"array_to_string({stopword_filter(split_tokens(normalize(expr)), words)}, ' ')"


def stem_text(expr: str, analyzer: str) -> str:
    out = expr
    for pattern, repl in C.stem_rules(analyzer, "re2"):
        out = f"regexp_replace({out}, '{pattern}', '{repl}', 'g')"
    return out


def analyze(expr: str, analyzer: str) -> str:
    toks = stopword_filter(split_tokens(normalize(f"lower({expr})")), C.stopwords(analyzer))
    return split_tokens(stem_text(f"array_to_string({toks}, ' ')", analyzer))


def term_array(expr: str, analyzer: str | None) -> str:
    return analyze(expr, analyzer) if analyzer else tokenize(expr)


# -- fixtures ---------------------------------------------------------------

FX1 = """
fx1_corpus AS (SELECT doc_id, '' AS title, text, lang AS language FROM documents),
fx1_qrels AS (SELECT b.item_id AS query_id, d.doc_id, d.lang AS language, 1 AS relevance
              FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
fx1_qlang AS (SELECT query_id, CASE WHEN min(language) = max(language) THEN min(language) ELSE 'mixed' END AS language
              FROM fx1_qrels GROUP BY query_id),
fx1_queries AS (SELECT b.item_id AS query_id, b.text, coalesce(l.language, 'mixed') AS language
                FROM benchmark b LEFT JOIN fx1_qlang l ON b.item_id = l.query_id)"""

FX2 = """
fx2_corpus AS (SELECT doc_id, '' AS title, text, lang AS language FROM documents),
fx2_queries AS (SELECT doc_id AS query_id, text, lang AS language FROM documents),
fx2_qrels AS (SELECT q.doc_id AS query_id, d.doc_id AS doc_id,
                     CASE WHEN q.lang = d.lang THEN q.lang ELSE 'mixed' END AS language, 1 AS relevance
              FROM documents q JOIN documents d ON q.source = d.source
              WHERE abs(q.doc_id - d.doc_id) <= 60 AND q.doc_id <> d.doc_id)"""

FX3 = """
fx3_vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings),
fx3_qrels AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CAST(NULL AS VARCHAR) AS language, 1 AS relevance
              FROM embeddings q JOIN embeddings d ON q.label = d.label
              WHERE abs(q.vec_id - d.vec_id) <= 50 AND q.vec_id <> d.vec_id)"""


def with_(*ctes: str) -> str:
    parts = [c.strip().rstrip(",") for c in ctes if c and c.strip()]
    return "WITH " + ",\n".join(parts) + "\n"


# -- BM25 -------------------------------------------------------------------

def bm25_ctes(prefix: str, corpus: str, queries: str, analyzer: str | None = None,
              corpus_text: str = "text", query_text: str = "text") -> str:
    """CTEs ``{prefix}_p`` (postings), ``{prefix}_t`` (terms), ``{prefix}_scored`` (query_id, doc_id, score)."""
    k1, b = C.BM25_K1, C.BM25_B
    p = prefix
    return f"""
{p}_dt AS (SELECT doc_id, {term_array(corpus_text, analyzer)} AS toks FROM {corpus}),
{p}_p0 AS (SELECT doc_id, term, dl, count(*) AS tf
           FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}_dt) GROUP BY doc_id, term, dl),
{p}_st AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n,
                  CAST(sum(tf) AS DOUBLE) / CAST(count(DISTINCT doc_id) AS DOUBLE) AS avgdl FROM {p}_p0),
{p}_p AS (SELECT term, doc_id, tf, dl,
                 tf * {dbl(k1 + 1.0)} / (tf + {dbl(k1)} * ({dbl(1.0 - b)} + {dbl(b)} * dl / (SELECT avgdl FROM {p}_st))) AS impact
          FROM {p}_p0),
{p}_t AS (SELECT term, count(*) AS df,
                 ln({dbl(1.0)} + ((SELECT n FROM {p}_st) - CAST(count(*) AS DOUBLE) + {dbl(0.5)}) / (CAST(count(*) AS DOUBLE) + {dbl(0.5)})) AS idf
          FROM {p}_p GROUP BY term),
{p}_qt AS (SELECT query_id, term, count(*) AS qtf
           FROM (SELECT query_id, unnest({term_array(query_text, analyzer)}) AS term FROM {queries}) GROUP BY query_id, term),
{p}_scored AS (SELECT q.query_id, p.doc_id, sum((q.qtf * t.idf) * p.impact) AS score
               FROM {p}_qt q JOIN {p}_t t ON q.term = t.term JOIN {p}_p p ON p.term = q.term
               GROUP BY q.query_id, p.doc_id)"""


def topk_cte(name: str, scored: str, k: int, exclude_self: bool = False) -> str:
    where = "WHERE query_id <> doc_id" if exclude_self else ""
    return f"""
{name} AS (SELECT query_id, doc_id, score, rank FROM (
    SELECT query_id, doc_id, round(score, {C.SCORE_DECIMALS}) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, {C.SCORE_DECIMALS}) DESC, doc_id ASC) AS rank
    FROM {scored} {where}) WHERE rank <= {int(k)})"""


def run_select(run: str) -> str:
    return f"SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM {run}"


# -- metrics ----------------------------------------------------------------

METRICS = ("ndcg", "map", "recall", "precision", "mrr", "recall_cap", "hole")


def per_query_ctes(prefix: str, run: str, qrels: str, k_values=C.K_VALUES) -> str:
    p = prefix
    kmax = max(k_values)
    ks = ", ".join(str(int(k)) for k in k_values)
    return f"""
{p}_rel AS (SELECT DISTINCT query_id, doc_id, 1 AS is_rel FROM {qrels} WHERE relevance > 0),
{p}_nrel AS (SELECT query_id, count(*) AS n_rel FROM {p}_rel GROUP BY query_id),
{p}_judged AS (SELECT DISTINCT doc_id, 1 AS judged FROM {qrels}),
{p}_r AS (SELECT r.query_id, r.rank, n.n_rel, coalesce(x.is_rel, 0) AS rel, coalesce(j.judged, 0) AS judged
          FROM {run} r JOIN {p}_nrel n ON r.query_id = n.query_id
          LEFT JOIN {p}_rel x ON r.query_id = x.query_id AND r.doc_id = x.doc_id
          LEFT JOIN {p}_judged j ON r.doc_id = j.doc_id
          WHERE r.rank <= {kmax}),
{p}_rc AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hits
           FROM {p}_r),
{p}_g AS (SELECT query_id, k, n_rel, sum(rel) AS hits,
                 sum(rel / log2(rank + 1)) AS dcg,
                 sum(rel * cum_hits / rank) AS ap,
                 min(CASE WHEN rel = 1 THEN rank END) AS first_rel,
                 sum(1 - judged) AS unjudged
          FROM {p}_rc, (SELECT unnest([{ks}]) AS k) ks WHERE rank <= k
          GROUP BY query_id, k, n_rel),
{p}_pq AS (SELECT query_id, CAST(k AS BIGINT) AS k, n_rel,
                  dcg / list_sum(list_transform(range(1, least(k, n_rel) + 1), lambda i: CAST(1 AS DOUBLE) / log2(i + 1))) AS ndcg,
                  ap / n_rel AS map,
                  hits / n_rel AS recall,
                  hits / k AS precision,
                  coalesce(CAST(1 AS DOUBLE) / first_rel, CAST(0 AS DOUBLE)) AS mrr,
                  hits / least(k, n_rel) AS recall_cap,
                  unjudged / k AS hole
           FROM {p}_g)"""


def metric_aggs() -> str:
    return ", ".join(f"round(avg({m}), {C.METRIC_DECIMALS}) AS {m}" for m in METRICS)


def evaluate_select(prefix: str) -> str:
    return f"SELECT k, count(*) AS n_queries, {metric_aggs()} FROM {prefix}_pq GROUP BY k"


# -- vectors ----------------------------------------------------------------

def hashed_tfidf_ctes(prefix: str, corpus: str, dim: int, id_col: str = "doc_id", text_col: str = "text",
                      queries: str | None = None, query_id: str = "query_id", query_weighting: str = "binary") -> str:
    """CTEs ``{prefix}_dv`` (id, dim, w) and, with ``queries``, ``{prefix}_qv``."""
    p = prefix
    bucket = "CAST(concat('0x', substr(md5(term), 1, 8)) AS BIGINT) % " + str(int(dim))
    sign = f"CASE WHEN substr(md5(term), 9, 1) < '8' THEN {dbl(1.0)} ELSE {dbl(-1.0)} END"
    out = f"""
{p}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT {id_col} AS id, unnest({tokenize(text_col)}) AS term FROM {corpus}) GROUP BY id, term),
{p}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {corpus}),
{p}_idf AS (SELECT term, ln(({dbl(1.0)} + (SELECT n FROM {p}_n)) / ({dbl(1.0)} + CAST(count(*) AS DOUBLE))) + {dbl(1.0)} AS idf
            FROM {p}_tf GROUP BY term),
{p}_dx AS (SELECT id, {bucket} AS dim, sum({sign} * ({dbl(1.0)} + ln(tf)) * idf) AS w
           FROM {p}_tf JOIN {p}_idf USING (term) GROUP BY id, dim),
{p}_dn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {p}_dx GROUP BY id),
{p}_dv AS (SELECT x.id, x.dim, x.w / n.norm AS w FROM {p}_dx x JOIN {p}_dn n USING (id) WHERE n.norm > 0)"""
    if queries:
        tfw = dbl(1.0) if query_weighting == "binary" else f"({dbl(1.0)} + ln(tf))"
        out += f""",
{p}_qtf AS (SELECT id, term, count(*) AS tf FROM (SELECT {query_id} AS id, unnest({tokenize(text_col)}) AS term FROM {queries}) GROUP BY id, term),
{p}_qx AS (SELECT id, {bucket} AS dim, sum({sign} * {tfw} * idf) AS w
           FROM {p}_qtf JOIN {p}_idf USING (term) GROUP BY id, dim),
{p}_qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {p}_qx GROUP BY id),
{p}_qv AS (SELECT x.id, x.dim, x.w / n.norm AS w FROM {p}_qx x JOIN {p}_qn n USING (id) WHERE n.norm > 0)"""
    return out


def dot_scored_cte(name: str, queries: str, corpus: str, metric: str = "dot") -> str:
    if metric == "dot":
        s = "list_dot_product(q.embedding, d.embedding)"
    else:
        s = ("list_dot_product(q.embedding, d.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding))"
             " * sqrt(list_dot_product(d.embedding, d.embedding)))")
    return f"{name} AS (SELECT q.id AS query_id, d.id AS doc_id, {s} AS score FROM {queries} q, {corpus} d)"


# -- trained vector indexes -------------------------------------------------------

def kmeans_ctes(p: str, parts: str, k: int, rounds: int, fit_rows: int, seed: str = C.SPLIT_SEED) -> str:
    """CTEs ``{p}_c`` (j, c, x): centres of the parts ``parts`` (id, j, x) after fixed rounds, and ``{p}_a`` (id, j, c)."""
    nearest = "min({'d': round(list_distance(v.x, m.x), 9), 'c': m.c}).c"
    out = f"""
{p}_seed AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY md5('{seed}:' || id), id) - 1 AS c FROM (SELECT DISTINCT id FROM {parts})),
{p}_fit AS MATERIALIZED (SELECT v.* FROM {parts} v JOIN {p}_seed s ON v.id = s.id WHERE s.c < {fit_rows}),
{p}_c0 AS MATERIALIZED (SELECT j, c, x FROM {p}_fit v JOIN {p}_seed s ON v.id = s.id WHERE s.c < {k})"""
    for r in range(rounds):
        out += f""",
{p}_n{r} AS (SELECT v.id, v.j, {nearest} AS c FROM {p}_fit v JOIN {p}_c{r} m ON v.j = m.j GROUP BY v.id, v.j),
{p}_m{r} AS (SELECT j, c, list(x ORDER BY i) AS x FROM (
    SELECT j, c, i, avg(x) AS x FROM (SELECT v.j, n.c, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS i
                                      FROM {p}_fit v JOIN {p}_n{r} n ON v.id = n.id AND v.j = n.j) GROUP BY j, c, i) GROUP BY j, c),
{p}_c{r + 1} AS MATERIALIZED (SELECT o.j, o.c, coalesce(n.x, o.x) AS x FROM {p}_c{r} o LEFT JOIN {p}_m{r} n ON o.j = n.j AND o.c = n.c)"""
    return out + f""",
{p}_c AS (SELECT * FROM {p}_c{rounds}),
{p}_a AS MATERIALIZED (SELECT v.id, v.j, {nearest} AS c FROM {parts} v JOIN {p}_c m ON v.j = m.j GROUP BY v.id, v.j)"""


def parts_cte(name: str, vectors: str, m: int, dim: int) -> str:
    sub = dim // m
    return f"{name} AS MATERIALIZED (SELECT id, j, list_slice(embedding, j * {sub} + 1, (j + 1) * {sub}) AS x FROM {vectors}, (SELECT unnest(range({m})) AS j))"


def pq_ctes(p: str, vectors: str, m: int, dim: int, k: int, rounds: int, fit_rows: int, depth: int) -> str:
    """CTE ``{p}_cand`` (query_id, doc_id): each vector's ``depth`` best others by its lookup tables."""
    return ",".join([parts_cte(f"{p}_x", vectors, m, dim), kmeans_ctes(p, f"{p}_x", k, rounds, fit_rows), f"""
{p}_lut AS MATERIALIZED (SELECT q.id, q.j, c.c, list_dot_product(q.x, c.x) AS s FROM {p}_x q JOIN {p}_c c ON q.j = c.j),
{p}_s AS (SELECT l.id AS query_id, a.id AS doc_id, sum(l.s) AS score FROM {p}_lut l JOIN {p}_a a ON l.j = a.j AND l.c = a.c GROUP BY l.id, a.id)""",
                     topk_cte(f"{p}_cand", f"{p}_s", depth, exclude_self=True)])


def exact_cte(name: str, cand: str, vectors: str) -> str:
    """CTE ``name`` (query_id, doc_id, score): exact products of candidates."""
    return f"""
{name} AS (SELECT c.query_id, c.doc_id, list_dot_product(q.embedding, d.embedding) AS score
           FROM {cand} c JOIN {vectors} q ON c.query_id = q.id JOIN {vectors} d ON c.doc_id = d.id)"""


def pca_ctes(p: str, vectors: str, dim: int, k: int, rounds: int) -> str:
    """CTEs ``{p}_u`` (comps DOUBLE[][]), ``{p}_cov`` (cov DOUBLE[][]) and ``{p}_y`` (id, embedding): the projections."""
    start = f"list_transform(range({dim}), lambda i: CAST((i * 31 + ({{}}) * 17) % 97 + 1 AS DOUBLE))"
    return f"""
{p}_e AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM {vectors}),
{p}_mean AS (SELECT i, avg(x) AS m FROM {p}_e GROUP BY i),
{p}_ij AS (SELECT a.i, b.i AS j, avg(a.x * b.x) AS s FROM {p}_e a JOIN {p}_e b ON a.id = b.id GROUP BY a.i, b.i),
{p}_cov AS MATERIALIZED (SELECT list(r ORDER BY i) AS cov FROM (SELECT s.i, list(s.s - a.m * b.m ORDER BY s.j) AS r
    FROM {p}_ij s JOIN {p}_mean a ON s.i = a.i JOIN {p}_mean b ON s.j = b.i GROUP BY s.i)),
{p}_u AS MATERIALIZED (SELECT done AS comps FROM (
  WITH RECURSIVE it(step, v, done) AS (
    SELECT 0, {start.format(0)}, []::DOUBLE[][]
    UNION ALL
    SELECT step + 1, CASE WHEN (step + 1) % {rounds} = 0 THEN {start.format(f"(step + 1) // {rounds}")} ELSE u END,
           CASE WHEN (step + 1) % {rounds} = 0 THEN list_append(done, u) ELSE done END
    FROM (SELECT step, done, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u FROM (
      SELECT step, done, list_transform(range(1, {dim + 1}), lambda i: w0[i] - coalesce(list_sum(list_transform(range(1, len(done) + 1), lambda j: f[j] * done[j][i])), 0)) AS w
      FROM (SELECT *, list_transform(done, lambda d: list_dot_product(d, w0)) AS f
            FROM (SELECT step, done, list_transform(cov, lambda r: list_dot_product(r, v)) AS w0 FROM it, {p}_cov WHERE step < {k * rounds}))))
  ) SELECT done FROM it WHERE step = {k * rounds})),
{p}_y AS MATERIALIZED (SELECT id, list_transform(comps, lambda u: list_dot_product(u, embedding)) AS embedding FROM {vectors}, {p}_u)"""
