"""The numbered operators on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import common, decontam, language, licenses, line_dedup, lsh_forest, maxscore, mixing, quality, token_counts
from docsift.llm import html_pages, html_text
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, key string"
LONG = " ".join(f"word{i}" for i in range(3000))


def table(spark, texts, source="s"):
    """documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0.5, 1, "k") for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "a b c d e f")]


def duck(spark, key, **tables):
    import __spark_entry__ as E
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    cur = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    return sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())


def rows(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("key", ["op1_maxscore", "op2_line_dedup", "op3_mix_sources", "op4_license_scan", "op5_near_dedup",
                                 "op6_decontaminate"])
def test_queries_equal_their_sql(spark, key):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    got = rows(E.queries()[key](spark, SF001))
    assert got == want and got


def test_maxscore_brute_force_ties_nulls_and_blocks(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [int(x) for x in rng.integers(-4, 5, 6)]) for i in range(300)] + [(7, [1, 1, 1, 1, 1, 1]), (400, None), (None, [1] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, weights array<long>")
    asked = df.where("vec_id % 50 = 0")
    got = [tuple(r) for r in maxscore.topk_inner_product(df, asked, k=5, query_block=3, seed_rows=20)
           .orderBy("query_id", "rank").collect()]
    want = []
    for q, w in sorted((v for v in vectors if v[0] is not None and v[0] % 50 == 0 and v[1]), key=lambda v: v[0]):
        best = sorted((-int(np.dot(w, x)), i) for i, x in vectors if i is not None and x and i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    assert maxscore.topk_inner_product(df.limit(0), df.limit(0)).count() == 0


def test_line_dedup_is_reversible_and_equal_beyond_the_broadcast_bound(spark):
    shared = [(i, f"own line {i}\n Shared LINE \nother {i % 3}") for i in range(100, 115)]
    docs = table(spark, ODD + shared)
    want = duck(spark, "op2_line_dedup", documents=docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    usual = line_dedup.line_dedup(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert rows(usual.drop("kept_text")) == want
    a = rows(line_dedup.line_dedup(docs))
    assert a == rows(line_dedup.line_dedup(docs, broadcast_mb=0)) and len(a) == docs.count()
    state = line_dedup.LineDedup(spark, min_docs=10).insert(docs)
    extra = table(spark, [(i, "Shared line\nnew") for i in range(200, 212)])
    before = rows(state.apply(docs))
    state.insert(extra)
    assert [r.n_dropped for r in state.apply(extra).collect()] == [2] * 12
    assert rows(state.delete(extra).apply(docs)) == before
    few = state.delete(table(spark, shared[:8])).apply(docs).where("doc_id = 110").first()
    assert few.n_dropped == 0 and few.kept_text == shared[10][1]
    out = line_dedup.LineDedup(spark, 10).insert(docs).rewrite(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_cuckoo_filter_holds_what_was_added_and_forgets_what_was_removed():
    keys = np.frombuffer(b"".join(hashlib.md5(str(i).encode()).digest() for i in range(5000)), "<u8").reshape(-1, 2)
    f = line_dedup.Cuckoo.of(keys[:4000])
    assert f.holds(keys[:4000]).all() and f.holds(keys[4000:]).sum() <= 1
    f.remove(keys[:2000])
    assert f.holds(keys[2000:4000]).all() and f.holds(keys[:2000]).sum() <= 1


def test_mixing_meets_its_targets_and_edge_rows(spark):
    docs = table(spark, ODD, None).unionByName(table(spark, [(i, "a b c d " * (i % 7)) for i in range(1000, 3000)], "x")) \
        .unionByName(table(spark, [(i, "p q r") for i in range(5000, 5300)], "y"))
    out = mixing.mix_sources(docs)
    assert out.count() == docs.count()
    for r in out.where("source is not null").groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.1 * r.g
    assert out.where("taken > 2 * size").count() == 0
    assert rows(out) == rows(mixing.mix_sources(docs))
    emitted = mixing.emit_mix(docs).groupBy("doc_id").count().where("doc_id = 1003").first()
    assert (emitted["count"] if emitted else 0) == out.where("doc_id = 1003").first().copies
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.emit_mix(docs.limit(0)).count() == 0


def test_license_scan_equals_brute_force_on_altered_templates(spark):
    """Units around the threshold, with words lost, repeated and added: the substring tests lose no match."""
    rng = np.random.default_rng(11)
    grams = licenses.template_bigrams()
    units = []
    for _, text in licenses.TEMPLATES:
        for _ in range(12):
            w = text.split(" ")
            for _ in range(int(rng.integers(0, 1 + len(w) // 4))):
                at = int(rng.integers(0, len(w)))
                w[at:at + 1] = [[], [w[at], w[at]], ["other"], [w[at].upper()]][int(rng.integers(0, 4))] if len(w) > 1 else w[at:at + 1]
            units.append(" ".join(w))
    want = {}
    for i, unit in enumerate(units):
        words = re.findall("[a-z0-9]+", unit.lower())
        own = {f"{a} {b}" for a, b in zip(words, words[1:])}
        dice, name = min((-2 * len(own & set(g)) / ((len(own) + len(g)) or 1), n) for n, g in grams)
        if -dice >= licenses.THRESHOLD:
            want[i] = (name, -dice)
    got = {r.doc_id: (r.license, r.dice) for r in licenses.license_scan(table(spark, enumerate(units))).collect()}
    assert got == want and 0 < len(want) < len(units)


def test_license_scan_edges(spark):
    docs = table(spark, ODD + [(20, "x\nReleased under the MIT License.\nReleased, under the MIT license"),
                               (21, "Released under the"), (22, licenses.TEMPLATES[2][1].replace(" the ", "\nthe "))])
    got = {(r.doc_id, r.license): r.n_units for r in licenses.license_scan(docs).collect()}
    assert got == {(20, "MIT"): 2, (22, "MIT"): 1}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_scan_finds_wrapped_and_inner_notices(spark):
    import textwrap
    prose = "\n".join(f"the text of line {i} tells of this and of that, and of the software" for i in range(40))
    texts, want = [], {}
    for name, template in licenses.TEMPLATES:
        if len(template.split()) > 8:  # wrapped above prose
            want[len(texts)] = (name, 1)
            texts.append(textwrap.fill(template, 72) + "\n" + prose)
        want[len(texts)] = (name, 1)  # a sentence of a longer line
        texts.append("Here it is told who wrote these pages, and when. " + template + " More of it is told in the next part of the pages.")
    want[len(texts)] = ("MIT", 2)  # a matching line and, apart from it, an inner notice
    texts.append(f"Released under the MIT License.\n{prose} Released under the MIT License. {prose}")
    want[len(texts)] = ("MIT", 1)
    texts.append(prose + "\nReleased under\nthe MIT License.\n" + prose)
    texts.append(prose)
    got = {r.doc_id: (r.license, r.n_units) for r in licenses.license_scan(table(spark, enumerate(texts))).collect()}
    assert got == want
    twice = licenses.license_scan(table(spark, [(1, texts[0]), (1, texts[0]), (None, texts[0])])).collect()
    assert {(r.doc_id, r.n_units) for r in twice} == {(1, 2), (None, 1)}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 200)]
    texts = list(ODD[:-1])
    for i in range(100, 160):  # a chain and a star of copies with a few words changed
        copy = list(base)
        for at in rng.integers(0, 200, i % 9):
            copy[at] = f"new{i}"
        texts.append((i, " ".join(copy)))
    docs = table(spark, texts).dropDuplicates(["doc_id"])
    assert rows(lsh_forest.near_duplicates(docs)) == duck(spark, "op5_near_dedup", documents=docs)
    odd = lsh_forest.near_duplicates(table(spark, ODD))
    assert odd.count() == len(ODD)
    assert {(r.doc_id, r.component_id, r.kept) for r in odd.collect()} >= {(1, 1, True), (6, 5, False), (None, None, True)}
    assert lsh_forest.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination_edges(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = table(spark, ODD + [(50, LONG + " " + item.upper() + " " + LONG), (51, item[:40]), (52, "tiny item")])
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (5, "a b c d e f")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaked_items(docs, items).collect()}
    assert got == {(50, 1), (52, 2), (None, 5)}
    assert decontam.clean_documents(docs, items).count() == docs.count() - 3
    assert decontam.leaked_items(docs.limit(0), items).count() == 0 == decontam.leaked_items(docs, items.limit(0)).count()


def test_pipeline_decides_by_row_not_by_doc_id(spark):
    import corpus_pipeline as C
    item = " ".join(f"q{i}" for i in range(30))
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [(None, a), (None, item), (None, b), (7, c), (7, c + " " + item), (8, d), (None, None), (7, None)])
    got = sorted(str((r.doc_id, r.text)) for r in decontam.clean_documents(docs, items).collect())
    assert got == sorted(map(str, [(None, a), (None, b), (7, c), (8, d), (None, None), (7, None)]))

    docs = table(spark, [(3, a), (5, a), (5, b), (5, c), (2, c + " end"), (None, d), (None, a + " end"), (None, b), (None, None), (4, "")])
    got = C.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(
        map(str, [(3, a), (5, b), (2, c + " end"), (None, d), (None, None), (4, "")]))


def test_language_held_out_accuracy_and_edges(spark):
    import __spark_entry__ as E
    docs = common.documents(spark, SF001)
    got = E.queries()["op7_language"](spark, SF001).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    parser = language.train(docs)
    odd = {r.doc_id: r for r in language.identify(table(spark, ODD + [(9, "12 !?")]), parser).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and odd[5].lang_pred in parser.langs
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_short_items_are_found_inside_long_documents(spark):
    docs = table(spark, [(1, "so the Tiny item was found in a long text"), (2, "tiny items"), (3, "item tiny item tiny"), (4, "one"),
                         (None, "a b c d e f"), (5, LONG), (6, "tiny item"), (7, None)])
    items = spark.createDataFrame([(1, "tiny item"), (2, "b c d e"), (3, "word7"), (4, "c b a"), (5, ""), (6, None)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.n_shared, r.n_item, r.containment) for r in decontam.leaked_items(docs, items).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(d, i, 1, 1, 1.0) for d, i in ((1, 1), (3, 1), (6, 1), (None, 2), (5, 3))]))
    assert sorted(str(r.doc_id) for r in decontam.clean_documents(docs, items).collect()) == ["2", "4", "7"]


def test_languages_of_short_and_of_long_texts_are_learned(spark):
    rng = np.random.default_rng(3)
    words = {k: ["".join(rng.choice(list(k), 5)) for _ in range(50)] for k in ("abcdef", "ghijkl", "mnopqr")}
    text = {k: lambda n, w=w: " ".join(rng.choice(w, n)) for k, w in words.items()}
    rows = [(i, text["abcdef"](60), "mid") for i in range(70)] + [(100 + i, text["ghijkl"](4), "notes") for i in range(300)]
    rows += [(500 + i, text["mnopqr"](5000), "books") for i in range(2)] + [(600, "12 34", "digits"), (601, None, "none"), (602, "xyz", None)]
    parser = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.langs == ["books", "mid", "notes"]
    assert parser.predict([text[k](12) for k in words])[0] == ["mid", "notes", "books"]
    assert len(parser.automata[2].table) > 64 * 24  # more than 64 notes


def test_every_language_keeps_its_letters():
    rng = np.random.default_rng(4)
    first = {"zh": 0x4E00, "ru": 0x430, "el": 0x3B1, "he": 0x5D0, "ar": 0x628, "th": 0xE01, "hi": 0x915, "ka": 0x10D0,
             "hy": 0x561, "am": 0x1200, "ja": 0x3042, "ko": 0xAC00, "en": ord("a")}
    words = {k: ["".join(chr(at + i) for i in rng.integers(0, 1500 if k == "zh" else 17, 4)) for _ in range(400)] for k, at in first.items()}
    text = {k: lambda n, w=w: " ".join(rng.choice(w, n)) for k, w in words.items()}
    parser = language.Parser({k: [t(800)] for k, t in text.items()})
    held = {k: t(20) for k, t in text.items()}
    assert parser.predict(list(held.values()))[0] == list(held)
    sample = language.normalise(text["zh"](600))
    parser = language.Parser({"zh": [sample]})
    asked, plain, at = language.normalise(sample[:200] + "".join(c for c in held["zh"] if c in sample) + sample[500:700]), 0, 0
    while at < len(asked):
        n = 1
        while at + n < len(asked) and asked[at:at + n + 1] in sample:
            n += 1
        plain, at = plain + 1, at + n
    codes = parser.encode(asked)
    assert len(codes) < language.BLOCK and len(parser.automata[0].keys) and parser.phrases([codes])[0, 0] == plain


def test_cross_parse_counts_equal_a_plain_parse():
    text, train = "abracadabra banana cadabra", "abra cadabra ban"
    parser = language.Parser({"x": [train]})
    plain, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in train:
            n += 1
        plain, at = plain + 1, at + n
    assert parser.phrases([parser.encode(text)])[0, 0] == plain


def test_token_counts_equal_the_library_and_the_cache_is_used(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    strange = [(30, "<|endoftext|>x <|startoftext|>"), (31, "é é b c ΑΣ. don't"), (32, "a\x1cb\x85c")]
    given = common.documents(spark, SF001).withColumn("doc_id", F.col("doc_id") + 1000)
    docs = table(spark, ODD + strange).unionByName(given, allowMissingColumns=True)
    counter, cache = token_counts.Counter(path), str(tmp_path / "cache")
    got = token_counts.token_counts(docs, counter, cache)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got.where("doc_id > 6 OR doc_id < 3").collect():
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(t.encode(text, add_special_tokens=False).ids)), r.doc_id
    size = token_counts.read_cache(spark, cache).count()
    assert got.count() == docs.count() and size == token_counts.read_cache(spark, cache).select("content").distinct().count()
    assert rows(token_counts.token_counts(docs, counter, cache)) == rows(got)
    assert token_counts.read_cache(spark, cache).count() == size
    assert token_counts.token_counts(docs.limit(0), counter).count() == 0


def test_quality_against_labels_and_edges(spark):
    docs = common.documents(spark, SF001.replace("0.001", "0.01"))
    model, scorer = quality.train(docs)
    assert min(model.accuracies().values()) > 0.6
    got = quality.score(docs, scorer).join(spark.read.parquet(SF001.replace("0.001", "0.01") + "/labels.parquet"), "doc_id")
    assert got.where("accepted = (quality = 1)").count() >= 0.93 * got.count()
    odd = {r.doc_id: r for r in quality.score(table(spark, ODD), scorer).collect()}
    assert not odd[1].accepted and not odd[2].accepted and odd[1].score == 0
    assert quality.accepted(table(spark, ODD), scorer).columns == SCHEMA.replace(",", "").split()[::2]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0))[1]).count() == 0


def test_quality_sample_is_bounded_by_texts_whatever_the_ids(spark, monkeypatch):
    docs = common.documents(spark, SF001).select("doc_id", "text")
    for changed in (docs.withColumn("doc_id", F.lit(1).cast("long")), docs.withColumn("doc_id", F.lit(None).cast("long")),
                    docs.unionByName(docs).unionByName(docs)):
        seen = []
        monkeypatch.setattr(quality, "fit", lambda samples, targets: seen.append(targets) or (np.zeros(1 << quality.BITS), 0.0))
        quality.train(changed, sample_docs=5)
        assert [(t > 0.5).sum() for t in seen] == [5] and [(t < 0.5).sum() for t in seen] == [5]


def test_main_text_of_generated_and_given_pages(spark):
    field = html_text.trained()
    wrong = n = 0
    for page, labels in html_pages.labelled_pages(700)[600:]:
        got = field.decode([html_text.features(b) for b in html_pages.blocks(page)])
        assert [b[0] for b in html_pages.blocks(page)] == [t for t, _ in labels]
        wrong, n = wrong + sum(a != y for a, (_, y) in zip(got, labels)), n + len(labels)
    assert wrong <= 0.03 * n
    pages = spark.read.parquet(SF001 + "/pages.parquet").limit(40)
    for r in html_text.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        assert r.text.split()[-3:] == re.sub("<[^>]*>", " ", article).split()[-3:] and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (3, "u", "<div <p>a &amp b<script>x</", 3)],
                                "page_id long, url string, html string, text long")
    assert html_text.extract_text(odd).count() == 3 and html_text.extract_text(odd.limit(0)).count() == 0


def test_fallback_text_and_formulas_are_blocks():
    page = ("<html><head><title>t</title><style>s</style></head><body><p>Let <math><mi>x</mi><mo/>=1</math> be</p>"
            "<noscript><p>no script</p></noscript><p><svg><path/><text>label</text></svg> after</p><video>old <b>browser</b></video>"
            "<p><svg/>end</p><iframe>i</iframe><template><p>u</p></template></body></html>")
    got = html_pages.blocks(page)
    assert [b[0] for b in got] == ["Let x=1 be", "no script", "label after", "old browser", "end"]
    assert "t:svg" not in got[-1][1]


def test_pipeline_stages(spark):
    import corpus_pipeline as C
    docs = common.documents(spark, SF001)
    seen, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for i, (_, stage) in enumerate(C.STAGES):
        docs = common.stored(stage(spark, docs, SF001), "test-stage")
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= seen and now
        assert docs.columns == (columns if i < 4 else columns + ["copy"])
        seen = now
        if i == 3:
            assert decontam.leaked_items(docs, common.documents(spark, SF001, "benchmark")).count() == 0
            assert lsh_forest.near_duplicates(docs).where("not kept").count() == 0


# -- columns of any name, equal rows, samples of different length ------------------

def odd_columns(spark, texts):
    """documents with the names that operators once made for themselves."""
    extra = {"_id": 1, "_row": 2, "_digest": "d", "_rate": 0.5, "_source": "z", "copy": 9, "row": 3, "_leaked": True, "digest": "e", "draw": 0.1}
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as P
    near = " ".join(f"w{i}" for i in range(60))
    docs = odd_columns(spark, ODD + [(20, near), (21, near + " more")])
    out = P.near_stage(spark, docs, SF001)
    assert out.columns == docs.columns and out.where("_rate = 0.5 AND _row = 2 AND copy = 9").count() == out.count()
    mixed = mixing.emit_mix(docs)
    assert sorted(mixed.columns) == sorted(docs.columns) and mixed.where("copy < 1 OR _source <> 'z'").count() == 0
    assert P.benchmark_stage(spark, docs, SF001).columns == docs.columns
    for mb in (64, 0):  # 0: beyond the broadcast bound
        out = line_dedup.LineDedup(spark, 1, broadcast_mb=mb).insert(docs).rewrite(docs)
        assert out.columns == docs.columns and out.where("row = 3 AND _row = 2").count() == docs.count()


def test_near_stage_keeps_one_of_equal_rows(spark):
    import corpus_pipeline as P
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = odd_columns(spark, [(3, a), (3, a), (3, a), (5, b), (5, a), (None, a), (None, b), (None, b), (None, None), (None, None), (7, "")])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in P.near_stage(spark, docs, SF001).collect()), key=str)
    assert got == sorted([(False, 3, a), (False, 5, b), (True, 0, None), (False, 7, "")], key=str)
    alone = odd_columns(spark, [(1, a), (2, a + " x"), (3, b)])
    assert sorted(r.doc_id for r in P.near_stage(spark, alone, SF001).collect()) == [1, 3]


def test_mix_draws_apart_for_rows_that_share_an_id(spark):
    """With all ids null the taken words still come near every source's target."""
    docs = spark.createDataFrame([(None, f"w{i} " * 5, "en", "abc"[i % 3], 1) for i in range(3000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.05 * r.g


def test_maxscore_traverses_the_essential_lists_only():
    rng = np.random.default_rng(2)
    rows = rng.integers(-20, 20, (4000, 32)).astype(float)
    rows[:, 8:] /= 10
    rows = np.floor(rows)
    q = rows[0]
    scores = rows @ q
    kth = np.sort(scores)[-5]
    low, high = rows.min(axis=0), rows.max(axis=0)
    found, got = maxscore.TopK._search(q, np.ascontiguousarray(rows.T), np.maximum(q * low, q * high), np.minimum(q * low, q * high), kth)
    assert found.tolist() == np.flatnonzero(scores >= kth).tolist() and (got == scores[found]).all()


def test_language_samples_of_different_length_are_comparable(spark):
    """A language of a few hundred letters is still told from others with long samples."""
    docs = [(r.text, r.lang) for r in common.documents(spark, SF001).where("length(text) > 400").select("text", "lang").collect()]
    samples = {}
    for text, lang in docs:
        samples.setdefault(lang, []).append(text)
    langs = sorted(samples)
    for short in langs:
        cut = {x: ["\n".join(t[::2])[:1000] if x == short else "\n".join(t[::2])] for x, t in samples.items()}
        parser = language.Parser(cut)
        held = [t for t in samples[short][1::2]]
        right = sum(x == short for x in parser.predict(held)[0])
        assert right >= 0.9 * len(held), (short, right, len(held))


def test_license_families_are_told_apart(spark):
    """Every template's own notice, and it among other text, is found under its own name only."""
    texts = [(i, text) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    texts += [(1000 + i, "Some words before it.\n" + text + "\nand more words after.") for i, text in texts]
    got = {}
    for r in licenses.license_scan(table(spark, texts)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {i: {licenses.TEMPLATES[i % 1000][0]} for i, _ in texts}
