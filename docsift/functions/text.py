"""Text column functions: normalise, tokenise, stopwords, light stemming, analyzers.

All of these are built-in Spark expressions (regexp_replace, split, filter,
array_join), so they stay inside whole-stage code generation where possible
and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift import constants as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(text) -> Column:
    """Replace every run of non-word characters by one space (Unicode-aware ``\\W+``)."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), C.NON_WORD_REGEX, " ")


def split_tokens(normalized) -> Column:
    """Split a normalised string (single spaces between tokens) without empty tokens.

    After normalisation only an all-space string can produce an empty token, so a
    CASE replaces a per-element lambda filter and the expression stays codegen-able.
    """
    t = F.trim(_col(normalized))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def tokenize(text, lowercase: bool = True) -> Column:
    """``re.sub(r'\\W+', ' ', text).split()``, optionally lower-cased first."""
    t = _col(text)
    if lowercase:
        t = F.lower(t)
    return split_tokens(normalize_text(t))


def stopword_filter(tokens, words) -> Column:
    """Drop tokens whose lower-case form is in ``words`` (case of the kept tokens is preserved)."""
    words = list(words)
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(words))


def remove_stopwords(text, languages) -> Column:
    """Reference stopword removal: normalise, split, drop stopwords, re-join by one space."""
    if isinstance(languages, str):
        languages = [languages]
    words = C.stopwords_union(languages)
    return F.array_join(stopword_filter(split_tokens(normalize_text(text)), words), " ")


def shorten(text, n: int = 500) -> Column:
    """First ``n`` characters (code points), like Python slicing ``s[:n]``."""
    return F.substring(_col(text), 1, n)


def stem_text(normalized, analyzer: str) -> Column:
    """Apply the light stemmer of ``analyzer`` to a space-separated token string."""
    out = _col(normalized)
    for pattern, repl in C.stem_rules(analyzer, "java"):
        out = F.regexp_replace(out, pattern, repl)
    return out


def analyze(text, analyzer: str) -> Column:
    """Language analyzer: lower-case, tokenise, drop the language's stopwords, stem.

    Returns an array of terms.
    """
    toks = stopword_filter(split_tokens(normalize_text(F.lower(_col(text)))), C.stopwords(analyzer))
    return split_tokens(stem_text(F.array_join(toks, " "), analyzer))


def full_text(title, text) -> Column:
    """``title + ' ' + text`` (titles are empty, so this has a leading space)."""
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(text), F.lit("")))


def sep_text(title, text) -> Column:
    """Bi-encoder input ``title [SEP] text``."""
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(C.SEP_TOKEN), F.coalesce(_col(text), F.lit("")))
