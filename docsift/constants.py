"""Plain-Python constants shared by the Spark operators and the SQL oracle texts.

No Spark import here: ``oracle_sql()`` builds its SQL from the same values the
DataFrame code uses, without a SparkSession.
"""

from __future__ import annotations

import functools
from importlib import resources

# ---------------------------------------------------------------------------
# Fixed values (must not change between runs; the oracle SQL repeats them)
# ---------------------------------------------------------------------------

#: Token separator: anything that is not a Unicode letter, digit or underscore.
#: (``\W`` is ASCII-only in Java, and ``(?U)\W`` keeps combining marks, so spell it out.)
NON_WORD_REGEX = r"[^\p{L}\p{N}_]+"

#: BM25 parameters (Robertson/Zaragoza; the usual search-server defaults).
BM25_K1 = 1.2
BM25_B = 0.75

#: Retrieval cut-offs used for evaluation.
K_VALUES = (1, 3, 5, 10, 100)
#: Rerank depth and the default run depth.
RERANK_DEPTH = 100
TOP_K = 100

#: Score rounding before ranking (ties then break on doc_id ascending).
SCORE_DECIMALS = 6
#: Metric rounding.
METRIC_DECIMALS = 5

#: Language code -> analyzer name.  ``es`` stands in for ``it`` in the fixtures.
LANGUAGE_ANALYZER = {
    "de": "german",
    "fr": "french",
    "it": "italian",
    "en": "english",
    "es": "spanish",
}

#: Separator used by the bi-encoder input projection.
SEP_TOKEN = " [SEP] "

#: Training constants: batch size for in-batch negatives, warm-up share, epochs.
TRAIN_BATCH_SIZE = 16
WARMUP_FRACTION = 0.1
TRAIN_EPOCHS = 1
#: Hard negatives: dense miner stops once it has found more than 5 -> 6 negatives.
DENSE_HARD_NEGATIVES = 6
DENSE_MAX_SCORE = 30.0
#: Lexical miner: top 11 hits of each positive's text.
BM25_HARD_NEGATIVE_HITS = 11

#: Split fractions (10 % train / 90 % test) and the default seed.
TRAIN_FRACTION = 0.1
SPLIT_SEED = "42"

#: Light suffix stemmers: per analyzer, suffixes stripped once (longest first)
#: when at least ``min_stem`` characters remain.  English uses the three-rule
#: plural stemmer instead (ies->y, es->e, s->'').
LIGHT_SUFFIXES = {
    "german": (("ern", "em", "er", "en", "es", "e", "s"), 3),
    "french": (("ements", "ement", "euses", "euse", "eaux", "aux", "es", "e", "s", "x"), 3),
    "italian": (("i", "e", "a", "o"), 3),
    "spanish": (("es", "os", "as", "s", "o", "a", "e"), 3),
}


# ---------------------------------------------------------------------------
# Stopwords: Spark's StopWordsRemover defaults, kept as package text so that
# neither a JVM nor the Spark ML jar is needed to build the SQL texts.
# ---------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def stopwords(language_long: str) -> tuple[str, ...]:
    """Default stopword list for ``language_long`` (e.g. 'german'), in file order, without repeats."""
    text = resources.files("docsift.resources").joinpath(f"{language_long}.txt").read_text(encoding="utf-8")
    return tuple(dict.fromkeys(text.split()))


def stopwords_union(languages) -> tuple[str, ...]:
    out: list[str] = []
    for lang in languages:
        for w in stopwords(lang):
            if w not in out:
                out.append(w)
    return tuple(out)


# ---------------------------------------------------------------------------
# Stemmer rules rendered per regex dialect
# ---------------------------------------------------------------------------

def stem_rules(analyzer: str, dialect: str = "java") -> list[tuple[str, str]]:
    """Ordered (pattern, replacement) pairs applied to a space-separated token string.

    Each pattern matches one whole token end (``( |$)``) so one pass over the
    normalised text stems every token; group references are rendered as
    ``$1`` (Java) or ``\\1`` (RE2, DuckDB).
    """
    g = (lambda i: f"${i}") if dialect == "java" else (lambda i: "\\" + str(i))
    if analyzer == "english":
        # Harman's S-stemmer; first applicable rule only (the later rules cannot
        # re-fire on the output of an earlier one).
        return [
            (r"([^ ]{2,}[^ae ])ies( |$)", f"{g(1)}y{g(2)}"),
            (r"([^ ]{2,}[^aeo ])es( |$)", f"{g(1)}e{g(2)}"),
            (r"([^ ]{2,}[^us ])s( |$)", f"{g(1)}{g(2)}"),
        ]
    suffixes, min_stem = LIGHT_SUFFIXES[analyzer]
    alt = "|".join(suffixes)
    return [(rf"([^ ]{{{min_stem},}}?)(?:{alt})( |$)", f"{g(1)}{g(2)}")]


# ---------------------------------------------------------------------------
# Random hyperplanes for the bucketed ANN operator: generated from a seed, so
# both engines see the same numbers.
# ---------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def hyperplanes(n_tables: int, n_bits: int, dim: int, seed: int = 7) -> tuple:
    import numpy as np

    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((n_tables, n_bits, dim))
    planes = np.round(planes, 4)
    return tuple(tuple(tuple(float(x) for x in bit) for bit in table) for table in planes)
