"""Near-duplicate components by an LSH forest over MinHash signatures.

* Every text becomes its set of distinct five-word shingles; equal sets are one class, represented by its
  smallest doc_id.  Representatives get a signature of ``TREES * WIDTH`` MinHash values.
* A tree of the forest is one order of the signature: ``DEPTH`` values starting at the tree's own ``WIDTH``.
  All trees are sorted at once by (tree, key) with a range partitioning, so a large region is spread over tasks.
  Neighbours with a common prefix of at least ``WIDTH`` values are candidates; a run with one such prefix is a region.
* Depth adapts per region, deepest first: each representative is tried with the neighbour of its longest common
  prefix over all trees, then with its other neighbours, then regions that still hold several components are tried
  against their best connected member, and at last every remaining pair of a region in different components.
  Pairs inside one component need no trial, so large groups of copies cost about one trial a copy, and no
  pair that shares a region is left out of the decision.
* Candidates are screened on the signatures (``SCREEN_SIGMA`` standard deviations below the threshold) and
  confirmed on the full sets.  A pair at Jaccard 0.75 misses all regions with probability (1 - 0.75^4)^32 = 5e-6.

Components grow by alternating large and small stars on written tables; nothing but counts reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import sliced, stored

SHINGLE = 5
PERCENT = 75
TREES, WIDTH, DEPTH = 32, 4, 8
#: Slots of the wide signature (8 bits each) that screens candidates, made for members of regions only.
SLOTS = 768
SCREEN_SIGMA = 4
#: Rows of a packed block on either side when the members of a region are compared.
OUTSIDE, MEMBERS = 128, 512
#: Word hashes remembered by a task.
MEMO = 50_000

_RNG = np.random.default_rng(20240601)
_MULTIPLY = _RNG.integers(1, 2 ** 63, TREES * WIDTH + SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, TREES * WIDTH + SLOTS, dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words split at ASCII whitespace."""

    def __init__(self, n: int = SHINGLE):
        self.n, self.memo = n, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes methods know ASCII only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        m = max(len(h) - self.n + 1, 1)
        out = np.full(m, min(len(h), self.n), np.uint64)
        for j in range(min(self.n, len(h))):
            out = (out ^ h[j:j + m]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signatures(sets: list[np.ndarray], functions=slice(0, TREES * WIDTH), kind="<u2") -> np.ndarray:
    """(len(sets), functions) MinHash values of non-empty sets, the low bits of ``kind``."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(_ADD[functions]), len(sets)), kind)
    for i, (a, b) in enumerate(zip(_MULTIPLY[functions], _ADD[functions])):
        out[i] = (np.minimum.reduceat((flat * a + b) >> np.uint64(32), starts) & np.uint64(0xFFFF)).astype(kind)
    return np.ascontiguousarray(out.T)


def _parts(sets, limit=200_000):
    """Runs of sets of about ``limit`` shingles, to keep the hash arrays small."""
    run, size = [], 0
    for s in sets:
        run.append(s)
        size += len(s)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def _base(batches):
    shingler = Shingler()
    for batch in sliced(batches):
        sets = [shingler(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        full = [s for s in sets if len(s)]
        rows = iter([r.tobytes() for part in _parts(full) for r in signatures(part)])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.array([next(rows) if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n_shingles", "digest", "signature"])


def _sets(batches):
    shingler, wide = Shingler(), slice(TREES * WIDTH, TREES * WIDTH + SLOTS)
    for batch in sliced(batches):
        sets = [shingler(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        rows = [r.tobytes() for part in _parts(sets) for r in signatures(part, wide, "u1")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                                          pa.array(rows, pa.binary()), batch.column(2)],
                                         names=["id", "hashes", "wide", "signature"])


def _trees(batches):
    slots = (np.arange(TREES)[:, None] * WIDTH + np.arange(DEPTH)[None, :]) % (TREES * WIDTH)
    for batch in sliced(batches):
        n = batch.num_rows
        if n:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, TREES * WIDTH)
            keys = np.ascontiguousarray(signs[:, slots]).view(f"S{2 * DEPTH}")  # n x TREES, compared as bytes below
            flat = keys.reshape(-1).tobytes()
            step = 2 * DEPTH
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)),
                pa.array([flat[i:i + step] for i in range(0, len(flat), step)], pa.binary()),
                pa.array(np.repeat(batch.column(0).to_numpy(), TREES))], names=["tree", "key", "id"])


def _neighbours(batches):
    """Scan one range of the sorted forest: region members, neighbour pairs, and the range's two ends."""
    kinds = {k: [] for k in ("kind", "tree", "prefix", "a", "b", "depth")}
    last = None
    first = None

    def put(kind, tree, key, a, b, depth):
        for k, v in zip(kinds, (kind, tree, key, a, b, depth)):
            kinds[k].append(v)

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(kinds["kind"], pa.string()), pa.array(kinds["tree"], pa.int32()),
                                          pa.array(kinds["prefix"], pa.binary()), pa.array(kinds["a"], pa.int64()),
                                          pa.array(kinds["b"], pa.int64()), pa.array(kinds["depth"], pa.int32())],
                                         names=list(kinds))
        for v in kinds.values():
            v.clear()
        return out

    member = False  # whether the last row is already given out as a member
    for batch in sliced(batches, 4096):
        tree, key, ids = (batch.column(i).to_pylist() for i in range(3))
        if first is None:
            first = (tree[0], key[0], ids[0])
            last = first
            put("edge", *first, first[2], 0)
            todo = range(1, len(ids))
        else:
            todo = range(len(ids))
        for i in todo:
            t, k, x = tree[i], key[i], ids[i]
            if k[:2 * WIDTH] == last[1][:2 * WIDTH] and t == last[0]:
                if not member:
                    put("member", t, k[:2 * WIDTH], last[2], 0, 0)
                put("member", t, k[:2 * WIDTH], x, 0, 0)
                put("pair", t, b"", min(x, last[2]), max(x, last[2]), common_prefix(k, last[1]))
                member = True
            else:
                member = False
            last = (t, k, x)
        yield flush()
    if first is not None:
        put("edge", *last, last[2], 1)
        yield flush()


def common_prefix(a: bytes, b: bytes) -> int:
    """Number of leading 16-bit values that two keys share."""
    for i in range(0, len(a), 2):
        if a[i:i + 2] != b[i:i + 2]:
            return i // 2
    return len(a) // 2


def _forest(reps: DataFrame) -> DataFrame:
    """Members of regions and neighbour pairs: kind, tree, prefix, a, b, depth."""
    spark = reps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reps.select("id", "signature").mapInArrow(_trees, "tree int, key binary, id long")
    found = stored(rows.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
                   .mapInArrow(_neighbours, "kind string, tree int, prefix binary, a long, b long, depth int"), "forest")
    # regions that cross the end of a range: the last row of one range and the first of the next (two rows a range)
    ends = found.where(F.col("kind") == "edge").select("tree", F.col("prefix").alias("key"), "a", "depth")
    order = Window.orderBy("tree", "key", "a", "depth")
    ends = ends.select("*", *[F.lag(c).over(order).alias(f"last_{c}") for c in ("tree", "key", "a")])
    short = [F.substring(c, 1, 2 * WIDTH) for c in ("key", "last_key")]
    ends = ends.where((F.col("tree") == F.col("last_tree")) & (short[0] == short[1]) & (F.col("a") != F.col("last_a")))
    same = F.when(F.col("key") == F.col("last_key"), F.lit(DEPTH)).otherwise(F.lit(WIDTH))
    def row(kind, a, b=F.lit(0).cast("long"), depth=F.lit(0)):
        return F.struct(F.lit(kind).alias("kind"), "tree", short[0].alias("prefix"), a.alias("a"), b.alias("b"), depth.alias("depth"))

    here, there = F.col("a"), F.col("last_a")
    ends = ends.select(F.explode(F.array(row("member", here), row("member", there), row(
        "pair", F.least(here, there), F.greatest(here, there), same))).alias("r")).select("r.*")
    return stored(found.where(F.col("kind") != "edge").unionByName(ends), "forest-all")


# -- trials and components ----------------------------------------------------

def _least_matches(percent: int) -> int:
    """Equal wide signature values that a pair at the threshold falls below with negligible probability."""
    share = percent / 100 + (1 - percent / 100) / 256
    return int(SLOTS * share - SCREEN_SIGMA * (SLOTS * share * (1 - share)) ** 0.5)


def _columns(rows, key, width, kind):
    return np.frombuffer(b"".join(m[key] for m in rows), kind).reshape(len(rows), width)


def _compare(least: int):
    """Pairs of one block of each side with enough equal wide values and different components.

    A pair is given out in the first tree only whose region holds both.
    """
    def run(batches):
        for batch in sliced(batches, 1):  # one pair of blocks as Python objects at a time
            found = []
            for row in batch.to_pylist():
                x, y = row["outside"], row["members"]
                wide = _columns(x, "wide", SLOTS, "u1"), _columns(y, "wide", SLOTS, "u1")
                same = np.zeros((len(x), len(y)), np.int16)
                for slot in range(SLOTS):
                    same += wide[0][:, slot, None] == wide[1][None, :, slot]
                apart = np.array([m["comp"] for m in x])[:, None] != np.array([m["comp"] for m in y])[None, :]
                i, j = np.nonzero((same >= least) & apart)
                signs = [_columns(side, "signature", TREES * WIDTH, "<u2") for side in (x, y)]
                shared = (signs[0][i] == signs[1][j]).reshape(-1, TREES, WIDTH).all(axis=2)
                for a, b in zip(*(k[shared.argmax(axis=1) == row["tree"]].tolist() for k in (i, j))):
                    found.append((min(x[a]["id"], y[b]["id"]), max(x[a]["id"], y[b]["id"]), int(same[a, b])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "n"])
    return run


def _alike(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, n): pairs of a region in different components with enough wide signature values equal.

    Both sides are packed into blocks of about ``OUTSIDE`` and ``MEMBERS`` rows, so that the join has a row for a
    pair of blocks and a task holds one such pair.  Two members of a region are neighbours and have been tried.
    """
    sized = regions.join(regions.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).where("size > 2"), ["tree", "prefix"])
    sized = sized.join(sets.select("id", "signature", "wide"), "id")

    def packed(rows, name, per_block):
        block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(per_block)).cast("long"))
        return (rows.groupBy("tree", "prefix", block.alias(f"{name}_block"))
                .agg(F.collect_list(F.struct("id", "comp", "signature", "wide")).alias(name)))

    blocks = packed(sized.where("comp <> top"), "outside", OUTSIDE).join(packed(sized, "members", MEMBERS), ["tree", "prefix"])
    pairs = blocks.select("tree", "outside", "members").mapInArrow(_compare(_least_matches(percent)), "a long, b long, n int")
    return pairs.groupBy("a", "b").agg(F.max("n").alias("n"))


def _confirm(percent: int):
    def run(batches):
        for batch in sliced(batches, 64):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _screen(least: int):
    def run(batches):
        for batch in sliced(batches):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "u1").reshape(batch.num_rows, SLOTS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(axis=1) >= least))
    return run


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """(a, b, column of a, column of b).  ``sets`` is already partitioned by id, so only pairs move."""
    side = sets.select("id", column)
    return (pairs.join(side.withColumnRenamed(column, "x"), F.col("a") == F.col("id")).drop("id")
            .join(side.withColumnRenamed(column, "y"), F.col("b") == F.col("id")).select("a", "b", "x", "y"))


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, screened: bool = False) -> DataFrame:
    """Those (a, b) whose sets have 100 * shared >= percent * union; ``screened`` pairs go to the full sets at once."""
    # written: the screen's and the confirmation's workers are not up at the same time
    likely = pairs if screened else stored(_with_both(pairs, sets, "wide").mapInArrow(
        _screen(_least_matches(percent)), "a long, b long"), "near-likely")
    return _with_both(likely, sets, "hashes").mapInArrow(_confirm(percent), "a long, b long")


def _stars(edges: DataFrame) -> bool:
    """Whether the (u, v) edges are a forest of stars: every u has one v, and no v is a u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")),
                                          F.struct(F.col("v").alias("id"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    other = ends.groupBy("id").agg(F.sum("out").alias("n"), F.min("out").alias("least")).where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0)))
    return other.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): for every endpoint of the (a, b) edges the smallest id of its component.

    Alternates large stars (every larger neighbour points to the least neighbour) and small stars (smaller
    neighbours and the vertex do) until the edges are stars, each vertex beside the least of its component.  Minima
    are pre-aggregated and the joins can be split by AQE, so a vertex with very many edges is no single group.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def _join_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after linking (a, b); ids without a row are components of their own."""
    joined = _named(links, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    new = components(joined).select(F.col("id").alias("comp"), F.col("comp").alias("merged"))
    touched = joined.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = comp.select("id", "comp").unionByName(touched.join(comp, "id", "left_anti").select("id", F.col("id").alias("comp")))
    return stored(rows.join(new, "comp", "left").select("id", F.coalesce("merged", "comp").alias("comp")), "components")


def _named(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs with the components ca and cb of both ends."""
    left = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    right = comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    return (pairs.join(left, "a", "left").join(right, "b", "left")
            .withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked at Jaccard >= percent / 100.

    Texts without words have no shingles and link with nothing; texts of fewer than five words are one shingle.
    ``component_id`` is the smallest doc_id reachable, ``kept`` marks it.  Rows with one doc_id are one vertex.
    Rows with a null doc_id come back unlinked (component_id null, kept true).  Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = stored(docs.select("doc_id", "text").mapInArrow(
        _base, "doc_id long, n_shingles long, digest binary, signature binary"), "near-base")
    known = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(known.groupBy("digest").agg(F.min(F.struct("doc_id", "signature")).alias("r"))
                     .select("digest", F.col("r.doc_id").alias("id"), F.col("r.signature").alias("signature")), "near-classes")
    forest = _forest(classes)
    regions = stored(forest.where(F.col("kind") == "member").select("tree", "prefix", F.col("a").alias("id")).distinct(), "near-regions")
    pairs = forest.where((F.col("kind") == "pair") & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.max("depth").alias("depth"))
    pairs = stored(pairs, "near-pairs")

    members = regions.select("id").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = classes.select("digest", "id", "signature").join(members, "id", "left_semi")
    sets = (docs.select("doc_id", "text").join(chosen.select(F.col("id").alias("doc_id"), "signature"), "doc_id")
            .mapInArrow(_sets, "id long, hashes binary, wide binary, signature binary")
            .repartition(n, "id").persist(StorageLevel.DISK_ONLY))

    # 1. each end's neighbour of the longest common prefix
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("you")),
                                          F.struct(F.col("b").alias("me"), F.col("a").alias("you")))).alias("e"), "depth")
    best = ends.groupBy("e.me").agg(F.max(F.struct("depth", (-F.col("e.you")).alias("you"))).alias("m"))
    first = best.select(F.least("me", -F.col("m.you")).alias("a"), F.greatest("me", -F.col("m.you")).alias("b")).distinct()
    tried = stored(first, "near-tried")
    links = stored(linked(tried, sets, percent), "near-links")
    comp = spark.createDataFrame([], "id long, comp long")
    comp = _join_components(comp, links)

    # 2. the other neighbours that are in different components
    def attempt(new, tried, links, comp, screened=False):
        new = stored(_named(new.select("a", "b").distinct(), comp).where("ca <> cb").select("a", "b")
                     .join(tried, ["a", "b"], "left_anti"), "near-new")
        if not new.limit(1).count():
            return tried, links, comp
        found = stored(linked(new, sets, percent, screened), "near-found")
        tried, links = tried.unionByName(new), links.unionByName(found)
        return tried, links, _join_components(comp, found) if found.limit(1).count() else comp

    tried, links, comp = attempt(pairs, tried, links, comp)

    # 3. regions of several components: all members against the best connected one
    def mixed(comp):
        named = regions.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        sizes = named.groupBy("tree", "prefix", "comp").agg(F.count(F.lit(1)).alias("n"))
        top = (sizes.groupBy("tree", "prefix").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("k"))
               .where("k > 1").select("tree", "prefix", F.col("m.comp").alias("top")))
        return stored(named.join(top, ["tree", "prefix"]), "near-mixed")

    open_regions = mixed(comp)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    hub = (open_regions.join(degree, "id", "left").groupBy("tree", "prefix")
           .agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("id")).alias("id"))).alias("h"))
           .select("tree", "prefix", (-F.col("h.id")).alias("hub")))
    spokes = (open_regions.join(hub, ["tree", "prefix"]).where("id <> hub")
              .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")))
    tried, links, comp = attempt(spokes, tried, links, comp)

    # 4. every remaining pair of a region in different components: members outside its largest one against all,
    # compared by signature in blocks; first each member's most alike, then all others that are still apart
    rest = stored(_alike(mixed(comp), sets, percent), "near-rest")
    sides = rest.select("n", F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b").alias("you")),
                                               F.struct(F.col("b").alias("me"), F.col("a").alias("you")))).alias("e"))
    best = sides.groupBy("e.me").agg(F.max(F.struct("n", (-F.col("e.you")).alias("you"))).alias("m"))
    tried, links, comp = attempt(best.select(F.least("me", -F.col("m.you")).alias("a"), F.greatest("me", -F.col("m.you")).alias("b")),
                                 tried, links, comp, screened=True)
    tried, links, comp = attempt(rest, tried, links, comp, screened=True)

    named = (base.join(classes.select("digest", "id"), "digest", "left").join(comp, "id", "left")
             .withColumn("component_id", F.coalesce("comp", "id", "doc_id")))
    # rows with one doc_id are one vertex, whatever their texts
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
                        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
