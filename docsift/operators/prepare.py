"""Dataset preparation (#3-#6, #9-#31): builders, slices, semi-joins, merges, subsets, splits.

Every operator is a DataFrame composition (semi/anti joins, windows, unions);
"first n" always means ordered by id, and random choices are md5 hashes of
``seed:id`` so Spark and SQL agree and no shuffle is needed for a split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift import constants as C


# -- builders (#3-#6) ---------------------------------------------------------

def build_corpus(raw: DataFrame, id_col: str = "id", text_col: str = "text", order_col: str | None = None,
                 language_col: str | None = None, assume_unique: bool = False) -> DataFrame:
    """corpus(doc_id string, title '', text, language): id cast to string, last row per id wins.

    ``order_col`` gives ingest order (e.g. ``_metadata.row_index``); the row with
    the largest value wins, like repeated dict assignment.  Deduplication shuffles
    the text by id; ``assume_unique=True`` (ids known to be unique) skips it and
    is a pure projection.
    """
    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    if assume_unique:
        return raw.select(F.col(id_col).cast("string").alias("doc_id"), F.lit("").alias("title"),
                          F.col(text_col).alias("text"), lang.alias("language"))
    rows = raw.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("language"),
                      (F.col(order_col) if order_col else F.lit(0)).alias("_ord"))
    last = (rows.groupBy("doc_id")
            .agg(F.max_by(F.struct("text", "language"), "_ord").alias("v")))
    return last.select("doc_id", F.lit("").alias("title"), "v.text", "v.language")


def build_qrels(raw: DataFrame, corpus: DataFrame, query_col: str = "id", doc_col: str = "corp_id",
                language_col: str | None = None) -> DataFrame:
    """Judgments whose document exists in the corpus, distinct (query, doc), relevance 1."""
    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    q = raw.select(F.col(query_col).cast("string").alias("query_id"), F.col(doc_col).cast("string").alias("doc_id"),
                   lang.alias("language"))
    kept = q.join(corpus.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    return (kept.groupBy("query_id", "doc_id").agg(F.max("language").alias("language"))
            .withColumn("relevance", F.lit(1)))


def build_queries(raw: DataFrame, qrels: DataFrame, id_col: str = "id", text_col: str = "text",
                  language_col: str | None = "language") -> DataFrame:
    """Queries having at least one judgment; text as string (null stays null)."""
    lang = F.col(language_col) if language_col else F.lit(None).cast("string")
    q = raw.select(F.col(id_col).cast("string").alias("query_id"), F.col(text_col).cast("string").alias("text"),
                   lang.alias("language"))
    return q.join(qrels.select(F.col("query_id").cast("string").alias("query_id")), "query_id", "left_semi")


def build_dataset_joint(queries: DataFrame, qrels: DataFrame, corpus: DataFrame):
    """Mutual filter: qrels of known queries, queries having a qrel; corpus untouched.

    Returns (queries, qrels, corpus, sizes) where ``sizes`` is (part, n).
    """
    qr = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    qs = queries.join(qr.select("query_id"), "query_id", "left_semi")
    sizes = (corpus.select(F.lit("corpus").alias("part"), F.col("doc_id").alias("id"))
             .unionByName(queries.select(F.lit("queries_before").alias("part"), F.col("query_id").alias("id")))
             .unionByName(qr.select(F.lit("qrels_queries").alias("part"), F.col("query_id").alias("id")))
             .unionByName(qs.select(F.lit("queries").alias("part"), F.col("query_id").alias("id")))
             .groupBy("part").agg(F.count_distinct("id").alias("n")))
    return qs, qr, corpus, sizes


def concat_languages(*dfs: DataFrame) -> DataFrame:
    """Bag union of dataset slices (``concatenate_datasets``)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def create_dataset(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, language: str | None = None,
                   language_long=None, remove_stopwords: bool = False, use_subset: bool = False,
                   subset_length: int = 100, subset_rule: str = "last"):
    """#11 dataset factory: language slice -> optional length-aware subset -> optional
    stopword removal (queries and corpus).  Returns (queries, qrels, corpus)."""
    from docsift.functions.text import remove_stopwords as _rm

    if language and language != "mixed":
        queries, qrels, corpus = filter_data(queries, qrels, corpus, language)
    if use_subset:
        queries, qrels, corpus, _ = create_subset(subset_length, queries, qrels, corpus, rule=subset_rule)
    if remove_stopwords and language_long:
        queries = queries.withColumn("text", _rm("text", language_long))
        corpus = corpus.withColumn("text", _rm("text", language_long))
    return queries, qrels, corpus


# -- filters and projections (#12-#18) ----------------------------------------

def filter_language(df: DataFrame, language: str, column: str = "language") -> DataFrame:
    return df.where(F.col(column) == F.lit(language))


def filter_queries_language(queries: DataFrame, language: str) -> DataFrame:
    """Queries are sliced only when the language is not 'mixed' (qrels always are)."""
    return queries if language == "mixed" else filter_language(queries, language)


def filter_data(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, language: str):
    """Same language on all three tables."""
    return (filter_language(queries, language), filter_language(qrels, language), filter_language(corpus, language))


def split_short(df: DataFrame, text_col: str = "text", max_len: int = 3) -> DataFrame:
    """Flag rows with ``len(text) <= max_len`` (both sides kept)."""
    return df.withColumn("is_short", F.coalesce(F.length(text_col), F.lit(0)) <= max_len)


# -- joins (#19-#27) -----------------------------------------------------------

def semi(df: DataFrame, keys: DataFrame, on: str = "query_id") -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def merge_qrels_right_wins(*qrels: DataFrame, mode: str = "right_wins") -> DataFrame:
    """``dict(a, **b)`` chained: for a query present in several inputs, the last input's
    whole judgment set replaces the earlier ones.  ``mode='union'`` is the plain
    (distinct) union of all judgments instead.

    The winning input per query comes from an aggregate (partial aggregation, so a
    query holding a large share of the judgments is not pulled into one task) and
    is joined back on (query_id, input).
    """
    if mode == "union":
        return concat_languages(*qrels).dropDuplicates(["query_id", "doc_id"])
    tagged = None
    for i, q in enumerate(qrels):
        t = q.withColumn("_prio", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    win = tagged.groupBy("query_id").agg(F.max("_prio").alias("_prio"))
    return tagged.join(win, ["query_id", "_prio"], "left_semi").drop("_prio")


def first_n_judged(queries: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """The first ``n`` queries (by id) that have a judgment (TakeOrdered, no global sort)."""
    return semi(queries, qrels).orderBy("query_id").limit(n)


def closure_subset(queries: DataFrame, qrels: DataFrame, corpus: DataFrame):
    """Qrels of the query subset, and the corpus shrunk to exactly their judged docs."""
    qr = semi(qrels, queries)
    co = corpus.join(qr.select("doc_id").distinct(), "doc_id", "left_semi")
    return queries, qr, co


def create_subset(n: int, queries: DataFrame, qrels: DataFrame, corpus: DataFrame, rule: str = "last",
                  min_len: int = 10):
    """Walk the first ``n + 1`` judged queries (by id); keep docs longer than ``min_len``.

    rule='last': a query is kept when its last judged doc (by doc id) is long (faithful);
    rule='any' : kept when any judged doc is long.  Kept queries keep their full judgment set.
    Returns (queries, qrels, corpus, short_count).
    """
    walked = qrels.select("query_id").distinct().orderBy("query_id").limit(n + 1)
    qr = semi(qrels, walked)
    j = qr.join(corpus.select("doc_id", F.length("text").alias("_len")), "doc_id", "left")
    j = j.withColumn("_long", F.coalesce(F.col("_len"), F.lit(0)) > min_len)
    if rule == "last":
        keep = j.groupBy("query_id").agg(F.max_by("_long", "doc_id").alias("_keep"))
    else:
        keep = j.groupBy("query_id").agg(F.max(F.col("_long").cast("int")).cast("boolean").alias("_keep"))
    kept = keep.where("_keep").select("query_id")
    co = corpus.join(j.where("_long").select("doc_id").distinct(), "doc_id", "left_semi")
    short = j.agg(F.count_if(~F.col("_long")).alias("short"))
    return semi(queries, kept), semi(qr, kept), co, short


def split_audit(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, split: DataFrame) -> DataFrame:
    """(metric, n): judged docs missing from the corpus, queries without qrels per split, set sizes.

    ``split`` is (query_id, split) with split in {'train', 'test'}.
    """
    q = queries.join(split, "query_id")
    judged_q = qrels.select("query_id").distinct().withColumn("_j", F.lit(1))
    q = q.join(judged_q, "query_id", "left")
    miss = (qrels.join(q.where(F.col("_j").isNotNull()).select("query_id"), "query_id", "left_semi")
            .join(corpus.select("doc_id"), "doc_id", "left_anti")
            .agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing_corpus").alias("metric"), "n"))
    per_split = q.groupBy("split").agg(
        F.count_if(F.col("_j").isNull()).alias("no_qrels"), F.count_if(F.col("_j").isNotNull()).alias("queries"))
    rows = per_split.select(F.explode(F.array(
        F.struct(F.concat(F.lit("missing_qrel_"), F.col("split")).alias("metric"), F.col("no_qrels").alias("n")),
        F.struct(F.concat(F.lit("queries_"), F.col("split")).alias("metric"), F.col("queries").alias("n")))).alias("s"))
    return miss.unionByName(rows.select("s.metric", "s.n"))


def hydrate_run(run: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Attach query and document text to a run (equi-joins on the ids)."""
    return (run.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
            .join(corpus.select("doc_id", "title", F.col("text").alias("doc_text")), "doc_id"))


# -- splits and sampling (#28-#33) ------------------------------------------------

def hash_key(id_col, seed: str = C.SPLIT_SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_threshold(fraction: float) -> str:
    return format(math.ceil(fraction * 2 ** 32), "08x")


def split_queries(queries: DataFrame, fraction: float = C.TRAIN_FRACTION, seed: str | None = C.SPLIT_SEED) -> DataFrame:
    """Deterministic hash split: (query_id, split) with ~``fraction`` in 'train'. No shuffle.

    ``seed=None`` draws a fresh unseeded split per call (the source's behaviour), using
    ``rand()`` per row; it is not reproducible and not SQL-checkable.
    """
    if seed is None:
        return queries.withColumn("split", F.when(F.rand() < F.lit(fraction), F.lit("train")).otherwise(F.lit("test")))
    train = F.substring(hash_key("query_id", seed), 1, 8) < F.lit(split_threshold(fraction))
    return queries.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def global_index(df: DataFrame, order_cols, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """1-based global row number without moving all rows into one partition.

    Range-partition + sort, number rows inside each partition, then add the
    running count of the preceding partitions (a table with one row per
    partition).  Range bounds come from sampling, so the numbered table is
    checkpointed (reliably, into ``spark.checkpoint.dir``) before the per-partition
    counts are taken: a recomputation could otherwise draw different bounds.
    """
    from docsift.session import cut_lineage

    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order_cols).sortWithinPartitions(*order_cols)
    # partition number in the upper 31 bits, row position in the lower 33: no second exchange
    s = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    s = (s.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_local", F.col("_at").bitwiseAND((1 << 33) - 1) + 1)
         .drop("_at"))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (s.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off"))


def split_ordered(queries: DataFrame, qrels: DataFrame, fraction: float) -> DataFrame:
    """First ``fraction * |queries|`` judged queries (by id) -> train, the other judged -> test.

    Unjudged queries get split = 'dropped'.
    """
    total = queries.count()
    cut = fraction * total
    judged = semi(queries, qrels).select("query_id")
    idx = global_index(judged, "query_id")
    lab = idx.select("query_id", F.when(F.col("idx") - 1 < F.lit(cut), "train").otherwise("test").alias("split"))
    return (queries.select("query_id").join(lab, "query_id", "left")
            .select("query_id", F.coalesce("split", F.lit("dropped")).alias("split")))


def shuffle_seeded(df: DataFrame, id_col: str, seed: str = "42") -> DataFrame:
    """Seeded shuffle: a deterministic hash order key (sort only where a limit follows)."""
    return df.withColumn("shuffle_key", hash_key(id_col, seed))


def sample_query(run: DataFrame, seed: str = "42") -> DataFrame:
    """All run rows of one pseudo-randomly chosen query (md5 of seed:id)."""
    pick = (run.select("query_id").distinct().withColumn("_k", hash_key("query_id", seed))
            .orderBy("_k").limit(1).select("query_id"))
    return run.join(pick, "query_id", "left_semi")


def top_docs(run: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Per query the first ``k`` documents with id, title and text (display table)."""
    return (run.where(F.col("rank") <= k)
            .join(corpus.select("doc_id", "title", "text"), "doc_id")
            .select("query_id", "rank", "doc_id", "score", "title", "text"))


def run_topk(run: DataFrame, k: int) -> DataFrame:
    """Cut a ranked run to ``k`` per query (rank already gives the order)."""
    return run.where(F.col("rank") <= k)
