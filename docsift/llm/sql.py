"""DuckDB SQL of the numbered operators, where SQL can express them."""

from __future__ import annotations

from docsift.llm.common import LOWER, SPACE, UPPER

OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.w, d.w)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_KEY = f"translate(regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '{UPPER}', '{LOWER}')"
OP2 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT DISTINCT doc_id, unnest(list_transform(lines, lambda x: {_KEY})) AS key FROM d),
gone AS (SELECT coalesce(list(key), []) AS keys FROM (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(*) >= 10)),
t AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(gone.keys, {_KEY})) AS kept FROM d, gone)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM t
"""

OP3 = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
                  coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS key FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
              2.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER o - cap, 0) AS cap_before, sum(w) OVER () - sum(w) OVER o + w AS w_left,
              1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s1
       WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT (budget - cap_before)::DOUBLE AS rest, w_left::DOUBLE AS w_left FROM s2
          WHERE cap >= w * (budget - cap_before)::DOUBLE / w_left::DOUBLE ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(w::DOUBLE * rest / w_left, cap)) AS target FROM s1 LEFT JOIN level ON true),
r AS (SELECT doc_id, key, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(rate)::BIGINT + (concat('0x', substr(md5('mix:' || key), 1, 13))::BIGINT::DOUBLE
         / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) * size AS taken
FROM r
"""


def _license_sql() -> str:
    from docsift.llm.licenses import THRESHOLD, template_bigrams
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, g))}])" for n, g in template_bigrams())
    return f"""
WITH t(license, grams) AS (VALUES {rows}),
l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT row_number() OVER () AS unit, * FROM (
        SELECT doc_id, unnest(CASE WHEN len(lines) > 1 THEN list_append(lines, text) ELSE lines END) AS line FROM l)),
w AS (SELECT unit, doc_id, regexp_extract_all(lower(regexp_replace(line, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS words FROM u),
b AS (SELECT unit, doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams
      FROM w WHERE len(words) > 1),
s AS (SELECT unit, doc_id, license, 2.0::DOUBLE * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice
      FROM b JOIN t ON len(b.grams) >= len(t.grams) * {THRESHOLD / (2 - THRESHOLD)} AND len(b.grams) <= len(t.grams) * {(2 - THRESHOLD) / THRESHOLD}),
m AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY dice DESC, license) AS r FROM s WHERE dice >= {THRESHOLD})
SELECT doc_id, license, count(*) AS n_units, max(dice) AS dice FROM m WHERE r = 1 GROUP BY doc_id, license
"""


OP4 = _license_sql()

#: (doc_id or item_id, distinct five-word shingles as lists of words) of a table.
def shingle_sql(table: str, key: str) -> str:
    return f"""
SELECT {key}, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SPACE}]+') AS w FROM {table})"""


OP6 = f"""
WITH d AS ({shingle_sql('documents', 'doc_id')}), i AS ({shingle_sql('benchmark', 'item_id')}),
p AS (SELECT item_id, len(g) AS n, unnest(g) AS h FROM i), q AS (SELECT doc_id, unnest(g) AS h FROM d)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n)::BIGINT AS n_item, count(*)::DOUBLE / any_value(n) AS containment
FROM p JOIN q USING (h) GROUP BY doc_id, item_id HAVING count(*) >= 0.75 * any_value(n)
"""

OP5 = f"""
WITH RECURSIVE s AS ({shingle_sql('documents', 'doc_id')}),
h AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.h = y.h AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
c AS (SELECT doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
st AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM c),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM c) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM p, st GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN p USING (term), st GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _repetition_sql() -> str:
    from docsift.llm.repetition import LEAST_WORDS, MAX_COVERED, MAX_REPEAT, WINDOW

    def windows(name: str, m: int) -> str:
        """Starts of the m-word windows that occur twice in a document."""
        return f"""
{name} AS (SELECT id, unnest(pos) AS pos FROM (
    SELECT id, list(i) AS pos FROM (SELECT id, words, unnest(range(1, n - {m - 2})) AS i FROM w WHERE n >= {m})
    GROUP BY id, array_to_string(list_slice(words, i, i + {m - 1}), ' ') HAVING count(*) > 1))"""

    def cover(name: str, m: int) -> str:
        return f"""
{name}_c AS (SELECT id, count(DISTINCT pos + o)::BIGINT AS n FROM {name}, (SELECT unnest(range(0, {m})) AS o) GROUP BY id)"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, words, len(words)::BIGINT AS n
      FROM (SELECT *, regexp_extract_all(text, '[^{SPACE}]+') AS words FROM d)),
l AS (SELECT id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^{SPACE}]') GROUP BY id),{windows("a", WINDOW)},{cover("a", WINDOW)},{windows("b", LEAST_WORDS)},{cover("b", LEAST_WORDS)},{windows("z", MAX_REPEAT + 1)},
f AS (SELECT w.id, w.doc_id, w.n AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
             coalesce(a_c.n, 0) AS n_repeat_words, coalesce(b_c.n, 0) AS n_covered,
             w.id IN (SELECT id FROM z) AS long_repeat
      FROM w LEFT JOIN l USING (id) LEFT JOIN a_c USING (id) LEFT JOIN b_c USING (id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_covered <= {MAX_COVERED}::DOUBLE * n_words AND NOT long_repeat AS kept FROM g
"""


OP12 = _repetition_sql()


def _spelling_sql() -> str:
    """crc32 by its byte table (made from the polynomial); near words by equal texts with a letter left out."""
    from docsift.llm.spelling import EVERY, MIN_LETTERS, MIN_TIMES
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    crc = "list_reduce({}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), {})"
    return f"""
WITH crc AS (SELECT {table}::BIGINT[] AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+') AS runs
      FROM documents),
r AS (SELECT id, run, count(*)::BIGINT AS n FROM (SELECT id, unnest(runs) AS run FROM d) GROUP BY id, run),
i AS (SELECT id, {crc.format("list_transform(string_split(id || ':', ''), lambda c: unicode(c)::BIGINT)", "4294967295::BIGINT")} AS start
      FROM (SELECT DISTINCT id FROM r), crc),
h AS (SELECT run, n, xor({crc.format("flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))", "start")}, 4294967295::BIGINT) AS h
      FROM r JOIN i USING (id), crc),
o AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
      FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_TIMES}),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM v),
y AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM x),
e AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM y a JOIN y b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
      UNION SELECT y.word, v.word, v.n FROM y JOIN v ON y.rest = v.word
      UNION SELECT v.word, y.word, y.n FROM y JOIN v ON y.rest = v.word),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM e),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
             CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN b ON v.word = b.word AND b.place = 1),
s AS (WITH RECURSIVE s(word, root) AS (
        SELECT word, word FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL)
      SELECT word, root FROM s WHERE root IN (SELECT word FROM f WHERE form IS NULL))
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM f JOIN s ON f.word = s.word
"""


OP13 = _spelling_sql()
