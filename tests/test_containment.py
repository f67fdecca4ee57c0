"""Exact containment join vs brute force, at all fingerprint levels."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docsift.operators.containment import LEVELS, SALTS, _kgram_hashes, anchor, contains_join, fingerprint_batches, winnow


DOCS = [
    (1, "Der Mieter zahlt die Miete pünktlich. Das Gericht entschied über die Berufung des Mieters."),
    (2, "Le tribunal a rejeté l'appel du locataire; la décision est définitive."),
    (3, "ab"),
    (4, "The quick brown fox jumps over the lazy dog while the court adjourned for lunch."),
    (5, "x" * 300 + "needle in a haystack of characters that is long enough" + "y" * 300),
]
PASSAGES = [
    (10, "Das Gericht entschied über die Berufung"),            # medium
    (11, "la décision est définitive."),                         # medium, accents
    (12, "ab"),                                                  # tiny
    (13, "b"),                                                   # 1 char
    (14, "needle in a haystack of characters that is long enough" + "y" * 30),  # long
    (15, "not present anywhere in the corpus at all, surely not"),
    (16, "the"),
]


def brute():
    return sorted((p, d) for p, pt in PASSAGES for d, dt in DOCS if pt in dt)


def test_contains_join_exact(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    passages = spark.createDataFrame(PASSAGES, "item_id long, text string")
    got = sorted((r["passage_id"], r["doc_id"]) for r in contains_join(passages, docs).collect())
    assert got == brute()


def test_winnow_guarantee():
    text = "abcdefghijklmnopqrstuvwxyz" * 10 + "UNIQUE-PASSAGE-" * 8 + "0123456789" * 10
    k, w = LEVELS[0]
    passage = text[200:200 + k + w + 5]
    assert anchor(passage, k) in set(winnow(text, k, w).tolist())


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_alpha = st.text(alphabet="ab é", min_size=0, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])
@given(docs=st.lists(_alpha, min_size=1, max_size=6), passages=st.lists(st.text(alphabet="ab é", min_size=1, max_size=70),
                                                                      min_size=1, max_size=6))
def test_contains_join_property(spark, docs, passages):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    expected = sorted((i, j) for i, pt in enumerate(passages) for j, dt in enumerate(docs) if pt in dt)
    got = sorted((r["passage_id"], r["doc_id"]) for r in contains_join(p, d).collect())
    assert got == expected


def test_documents_of_a_hot_hash_are_split(spark):
    """A passage that every document holds: its rows are dealt by (hash, salt), not by the hash alone."""
    shared = "the same long notice stands in every one of these documents, word by word, at some place of it"
    docs = spark.createDataFrame([(i, f"{i} own words " + shared + f" {i * 7} more") for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = contains_join(spark.createDataFrame([(1, shared)], "item_id long, text string"), docs)
        assert out.count() == 300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    salts = {r[0] for r in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).distinct().collect()}
    assert len(salts) == SALTS


def test_hashes_of_every_width_equal_the_plain_sum():
    text = "Größe, née 1984 – 漢字 " * 9
    cp = [ord(c) for c in text]
    for k in range(1, 20):
        plain = []
        for i in range(len(cp) - k + 1):
            h = 0
            for c in cp[i:i + k]:
                h = (h * 1_000_003 + c) % 2 ** 64
            h = (h ^ (h >> 31)) * 0x9E3779B97F4A7C15 % 2 ** 64
            plain.append(h ^ (h >> 29))
        assert _kgram_hashes(text, k).tolist() == plain
    assert _kgram_hashes("ab", 3).size == 0


def test_fingerprints_leave_in_small_batches_whatever_the_batch_of_texts():
    draw = random.Random(5)
    texts = [None, ""] + ["".join(draw.choices("abcdefgh ", k=400)) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    k, w = LEVELS[1]
    out = list(fingerprint_batches(iter([batch]), k, w, limit=500))
    rows = [(i, h) for b in out for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(out) > 10 and max(b.num_rows for b in out) < 500 + 400
    assert rows == [(i, int(h)) for i, t in enumerate(texts) for h in winnow(t, k, w)]
