"""Mixing sources to target weights, in DataFrame operations only.

Sizes are aggregated per source; a source's target is its weighted share of the budget, capped at
``max_rate`` times its size, the excess going to the others by weight.  The repetition rate of a
source is target / size: each of its documents is taken floor(rate) times, plus once more if its
hash-seeded draw falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import SPACE, stored
from docsift.operators.prepare import global_index

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_RATE = 2.0
SEED = "mix"
#: Sources up to which the table of rates (about 60 bytes a row) is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from 52 bits of md5(seed:doc_id:md5(text)); nulls draw as empty ones.

    With the text in it, rows that share an id, or have none, draw apart.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                            F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size, weight, target), one row per source.

    Sources in code point order, null last, take the weights in turn.  Targets share
    ``budget`` * all sizes by weight; whichever would exceed ``max_rate`` times its source's size stops there
    and the excess is shared again until none is above.  Each round is one aggregate over the sources, of which
    the driver sees three numbers.  If every source is full, all stop at their caps.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per_source = per_source.withColumn("last", F.col("source").isNull())
    ranked = global_index(per_source, ["last", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_rate))
    table = stored(ranked.select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "mix-sources")

    total = table.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    left, per_weight, n_full = budget * total, 0.0, -1
    while True:
        full = F.col("cap") < F.col("weight") * F.lit(left) / F.lit(per_weight) if per_weight else F.lit(False)
        got = table.agg(F.sum(full.cast("int")).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"),
                        F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if got["n"] is None or got["n"] == n_full or not got["weight"]:
            break
        n_full, left, per_weight = got["n"], budget * total - (got["cap"] or 0.0), got["weight"]
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(per_weight or 1.0))
    return table.select("source", "source_size", "weight",
                        (F.least("cap", share) if got["weight"] else F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE,
                seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) per row of ``docs`` (doc_id, text, source).

    ``copies`` is how often the mix takes the document, ``taken`` = copies * size.  Reruns agree, since the draw
    depends on seed, doc_id and text alone; rows equal in both share their draw and are each a document.
    Null and empty texts have size 0 and are taken by the same rule; a source without any words gets target 0 and
    copies 0.  A null source is a source of its own.  An empty table gives no rows.  Other columns are ignored.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               draw(F.col("doc_id"), F.col("text"), seed).alias("draw")), "mix-sizes")
    targets = source_targets(sizes, weights, budget, max_rate)
    rates = _rates(targets)
    return (sizes.join(rates, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("copies", _copies(F.col("draw"), F.col("_rate")))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def _rates(targets: DataFrame) -> DataFrame:
    """Targets with their repetition rate; broadcast up to BROADCAST_SOURCES rows, which are counted first."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate"))
    return F.broadcast(rates) if targets.count() <= BROADCAST_SOURCES else rates


def _copies(drawn: Column, rate: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (drawn < rate - whole).cast("long")).cast("long")


def emit_mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE,
             seed: str = SEED) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` as often as it is taken, with a number ``copy`` from 1.

    A column ``copy`` of ``docs`` is replaced, all others are kept, whatever their names.  Null and empty texts have size 0
    and are taken by their source's rate; very long texts count whole; a null source is a source of its own; rows
    equal in doc_id and text are taken equally often; an empty table gives no rows.
    """
    sizes = stored(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source")
                   .agg(F.sum("size").alias("size")), "mix-sizes")
    rates = _rates(source_targets(sizes, weights, budget, max_rate)).select("_source", "_rate")
    kept = [c for c in docs.columns if c != "copy"]
    names = [f"c{i}" for i in range(len(kept))]  # no name of a column can clash with one made here
    plain = docs.select(*kept).toDF(*names)
    id_, text, source = (F.col(names[kept.index(x)]) for x in ("doc_id", "text", "source"))
    taken = _copies(draw(id_, text, seed), F.col("_rate"))
    copies = F.when(taken > 0, F.sequence(F.lit(1).cast("long"), taken)).otherwise(F.array().cast("array<bigint>"))
    return (plain.join(rates, source.eqNullSafe(F.col("_source"))).select(*names, F.explode(copies).alias("copy"))
            .toDF(*kept, "copy"))
