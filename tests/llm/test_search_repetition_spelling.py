"""Ranked search, repetition rules and spelling variants against brute force, on odd rows and as registered queries."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import best_position, repetition, spelling
from tests.conftest import SF001
from tests.llm.test_operators import LONG, ODD, rows, table


@pytest.mark.parametrize("key", ["op11_ranked_search", "op12_repetition", "op13_spelling"])
def test_queries_equal_their_sql(spark, key):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    got = rows(E.queries()[key](spark, SF001))
    assert got == want and got


# -- ranked search ------------------------------------------------------------

def searched(docs, items, k):
    """Every score by definition."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(d, collections.Counter(cut.findall((t or "").translate(lower)))) for d, t in docs]
    total = [sum(c.values()) for _, c in words]
    n_docs, n_terms = sum(n > 0 for n in total), sum(total)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(cut.findall((t or "").translate(lower)))
    out = []
    for i, terms in sorted(asked.items()):
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in words) + 1))) for t in terms}
        found = [(-sum(weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms))) for t in terms if c[t]), d)
                 for (d, c), n in zip(words, total) if d is not None]
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1)]
    return out


@pytest.mark.parametrize("k,block_terms,postings,seed", [(10, 200_000, 1_000_000, 4096), (3, 4, 50, 5), (1, 9, 1, 1)])
def test_ranked_search_brute_force(spark, k, block_terms, postings, seed):
    rng = random.Random(3)
    vocabulary = ["the", "Of", "é1", "über", "x", "42", "rare", "Émile"] + [f"t{i}" for i in range(12)]
    texts = [(i, rng.choice([" ", "-", "_\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for i in range(400)]
    docs = texts + ODD + [(9000 + i, "rare rare x") for i in range(30)] + [(None, "rare é1 x 42"), (9000, "rare x")]
    items = [(1, "The rare X"), (1, "über"), (2, None), (3, " ,.;"), (None, "the of"), (4, "absent"), (5, "the the of é1 42 t3"),
             (6, " ".join(vocabulary)), (7, LONG), (0, "é1")]
    got = best_position.ranked_search(table(spark, docs).repartition(5), table(spark, items).withColumnRenamed("doc_id", "item_id"),
                                      k, block_terms, postings, seed)
    assert sorted(tuple(r) for r in got.collect()) == searched(docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert best_position.ranked_search(table(spark, ODD).limit(0), items).count() == 0
    assert best_position.ranked_search(table(spark, ODD[:3]), items).count() == 0
    assert best_position.ranked_search(table(spark, ODD), items.limit(0)).count() == 0


def shard_of(rng, n_docs, n_terms):
    sizes = rng.integers(1, n_terms, n_docs)
    terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes])
    tfs = rng.integers(1, 6, len(terms))
    lengths = rng.integers(20, 400, n_docs)
    weights = rng.integers(0, 4000, n_terms)
    return best_position.Shard(np.arange(n_docs) * 3, lengths, sizes, terms, tfs, weights, n_docs, int(lengths.sum())), sizes, terms


def test_best_positions_stop_early_and_only_strictly_below_the_kth_score():
    rng = np.random.default_rng(8)
    shard, sizes, terms = shard_of(rng, 3000, 40)
    owner = np.repeat(np.arange(3000), sizes)
    for query in (np.array([3]), np.array([1, 5, 9]), np.arange(40)):
        exact = np.bincount(owner, np.where(np.isin(terms, query), shard.impact, 0), 3000).astype(np.int64)
        want = sorted(zip((-exact).tolist(), (np.arange(3000) * 3).tolist()))[:10]
        shard.read = 0
        scores, ids = shard.best(query, 1, 10)
        assert sorted(zip((-scores).tolist(), ids.tolist())) == want
        if len(query) <= 3:
            assert shard.read < np.isin(terms, query).sum() / 2  # far from the lists' ends
    assert not (shard.seen.any() or shard.met.any() or shard.asked.any())
    # equal scores: all must be met before the smallest ids are known
    even = best_position.Shard(np.arange(500)[::-1].copy(), np.full(500, 30), np.ones(500, int), np.zeros(500, int),
                               np.ones(500, int), np.array([7]), 500, 15000)
    assert sorted(even.best(np.array([0]), 1, 10, first_rows=4)[1].tolist()) == list(range(10))


# -- repetition ---------------------------------------------------------------

def test_suffix_array_and_maximal_repeats_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 40)
        s = np.array([rng.randint(0, rng.choice([1, 2, 6])) for _ in range(n)], np.int64)
        order, lcp = repetition.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: list(s[i:]))

        def common(i, j):
            k = 0
            while i + k < n and j + k < n and s[i + k] == s[j + k]:
                k += 1
            return k
        assert lcp.tolist() == [common(order[i], order[i + 1]) for i in range(n - 1)]
        for least in (1, 2, 3):
            places = collections.defaultdict(list)
            for i in range(n):
                for m in range(least, n - i + 1):
                    places[tuple(s[i:i + m])].append(i)
            want, cover = set(), np.zeros(n, bool)
            for sub, ps in places.items():
                if len(ps) > 1:
                    for p in ps:
                        cover[p:p + len(sub)] = True
                    if len({int(s[p - 1]) if p else -1 for p in ps}) > 1 < len({int(s[p + len(sub)]) if p + len(sub) < n else -1 for p in ps}):
                        want.add((len(sub), tuple(ps)))
            found = repetition.maximal_repeats(s, order, lcp, least)
            assert sorted((m, tuple(sorted(order[a:b + 1].tolist()))) for m, a, b in found) == sorted(want)
            assert (repetition.covered(order, lcp, least) == cover).all()


def test_repetition_rules_on_odd_and_repetitive_texts(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    passage = " ".join(f"p{i}" for i in range(201))
    texts = ODD + [(10, clean), (11, "same five words come again " * 30), (12, clean + " " + " ".join(f"w{i}" for i in range(20))),
                   (13, clean + "\n" + " ".join(f"w{i}" for i in range(40))), (14, passage + " " + LONG + " " + passage),
                   (15, "a\n a\na\n\nb # $5 <b>"), (16, "a " * 40000), (17, "É\xa0x " + clean)]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in repetition.repetition_rules(docs).collect()}
    assert repetition.repetition_rules(docs).count() == len(texts)
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False) and got[3].n_words == 0
    assert got[10].kept and got[5].kept and got[6].kept
    assert got[11].base_failed and got[11].n_repeat_words == 150 and got[11].n_dup_lines == 0
    assert got[12].n_covered == 40 and got[12].longest_repeat == 20 and got[12].n_maximal == 1 and not got[12].kept  # 40 of 120
    assert got[13].n_repeat_words == 80 and got[13].base_failed
    assert got[14].longest_repeat == 201 and not got[14].base_failed and not got[14].kept and got[14].n_covered == 402
    assert (got[15].n_dup_lines, got[15].n_symbols, got[15].word_chars) == (1, 4, 10)
    assert got[16].n_repeat_words == 40000 and got[16].longest_repeat == 39999
    assert got[17].n_words == 101 and got[17].kept
    listed = [tuple(r) for r in repetition.maximal_repeat_rows(docs.where("doc_id in (10, 14)")).collect()]
    assert listed == [(14, 0, 201, 2, passage)]
    assert repetition.repetition_rules(docs.limit(0)).count() == 0 and repetition.maximal_repeat_rows(docs.limit(0)).count() == 0


# -- spelling -----------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(docs):
    """The whole result by definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = collections.Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(lower)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def spelled(rng, letters, lengths, count):
    return ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(count)]


@pytest.mark.parametrize("shard_words", [20_000, 7])
def test_spelling_variants_brute_force(spark, shard_words, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 3)
    rng = random.Random(4)
    words = spelled(rng, "abnoé", (5, 6), 250) + spelled(rng, "ABxy÷", (4, 5), 100)
    words += ["letter", "lettre", "lettres", "leter", "letterr"] * 3 + ["letter"] * 20 + ["x" * 5000, "x" * 4999, "y" + "x" * 4999] * 3
    texts = [(i, rng.choice([" ", "-", "1", "\n"]).join(rng.choices(words, k=60))) for i in range(120)]
    texts += [(300 + i, "planet " * 10 + "Planets " * 4 + "planetss " * 2) for i in range(10)]  # a chain of two steps
    texts += ODD + [(None, "letter letter lettrE")] + [(7, " ".join(words))] * 4
    got = spelling.spelling_variants(table(spark, texts), shard_words)
    want = variants(texts)
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()), key=lambda r: r[0]) == want
    assert len(want) > 100 and any(f for _, f, *_ in want) and any(r != f and f for _, f, r, *_ in want)


def test_trie_finds_exactly_the_words_one_edit_apart(monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 4)
    monkeypatch.setattr(spelling, "CELLS", 40)
    rng = random.Random(2)
    for _ in range(60):
        length = rng.randint(5, 8)
        words = list(dict.fromkeys(spelled(rng, "abnoé", (length,), 60)))
        for asking in (words, spelled(rng, "abnoé", (length - 1,), 40)):
            i, j = spelling.Trie(words).near(asking)
            assert sorted(zip(i.tolist(), j.tolist())) == [(x, y) for x, a in enumerate(asking) for y, b in enumerate(words) if one_edit(a, b)]


def test_each_pair_of_shards_is_asked_in_one_direction():
    """Of two words one edit apart with different shards exactly one asks the other's."""
    rng = random.Random(6)
    for depth in (1, 3, 5):
        allowed = {(role == spelling.LONGER, d) for role, d in spelling.steps(depth)}
        for _ in range(400):
            w = spelled(rng, "abcdefnopqr", (6,), 1)[0]
            at = rng.randrange(6)
            x = w[:at] + rng.choice("abcdefnopqr") + w[at + rng.randint(0, 1):]
            a, b = (spelling.count_matrix(spelling.letter_matrix([v]))[0, :depth] for v in (w, x))
            there = (len(x) > len(w), tuple((b - a).tolist())) in allowed
            back = (len(w) > len(x), tuple((a - b).tolist())) in allowed and len(x) == len(w)
            assert there or back
            if (a != b).any() or len(w) != len(x):
                assert there != back


def test_spelling_of_empty_tables(spark):
    docs = table(spark, ODD)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.where(F.col("text").isNull())).count() == 0
