"""Registered queries of the numbered operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to the whole of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import common as X
from docsift.llm import sql as S

QUERIES: dict = {}
ORACLE: dict = {}


def register(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return keep


@register(S.OP1)
def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top 5 of every embedding with vec_id divisible by 50, by integer inner product."""
    from docsift.llm.maxscore import quantised, topk_inner_product, usable
    rows = (X.documents(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
            .select("vec_id", quantised(F.col("embedding")).alias("weights")))
    return topk_inner_product(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


@register(S.OP2)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents, dropped from all of them."""
    from docsift.llm.line_dedup import line_dedup
    return line_dedup(X.documents(spark, sf_dir), min_docs=10).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@register(S.OP3)
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 over 150 % of all words, at most twice each."""
    from docsift.llm.mixing import mix_sources
    return mix_sources(X.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register(S.OP4)
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in the lines and whole texts of all documents."""
    from docsift.llm.licenses import license_scan
    return license_scan(X.documents(spark, sf_dir))


@register(S.OP6)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents by at least 0.75 of their five-word shingles."""
    from docsift.llm.decontam import leaked_items
    return leaked_items(X.documents(spark, sf_dir), X.documents(spark, sf_dir, "benchmark"))


@register(S.OP5)
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.75 over five-word shingles."""
    from docsift.llm.lsh_forest import near_duplicates
    return near_duplicates(X.documents(spark, sf_dir))


@register()
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-parsing, learned from three of four documents."""
    from docsift.llm.language import held_out, identify, train
    docs = X.documents(spark, sf_dir)
    return identify(docs, train(docs.where(~held_out(F.col("doc_id")))))


@register()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by a public tokenizer, through the digest cache."""
    import public_tokenizers
    from docsift.llm.token_counts import Counter, token_counts
    counts = token_counts(X.documents(spark, sf_dir), Counter(public_tokenizers.path("word_bpe_49k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@register()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from weak labels."""
    from docsift.llm.quality import score, train
    docs = X.documents(spark, sf_dir)
    return score(docs, train(docs)[1])


@register()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the conditional random field."""
    from docsift.llm.html_text import extract_text
    return extract_text(X.documents(spark, sf_dir, "pages"))


@register(S.OP11)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item by the Best Position Algorithm."""
    from docsift.llm.best_position import ranked_search
    return ranked_search(X.documents(spark, sf_dir), X.documents(spark, sf_dir, "benchmark"), k=10)


@register(S.OP12)
def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on repetition inside every document."""
    from docsift.llm.repetition import repetition_rules
    return repetition_rules(X.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register(S.OP13)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    from docsift.llm.spelling import spelling_variants
    return spelling_variants(X.documents(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
