"""Spelling variants: words one edit apart, found by tries over letter-group counts.

Letters fall into ``GROUPS`` groups (code points 13 apart share one).  A trie arranges the words of one length by
their successive letter-group counts.  Two words one edit apart differ by at most one letter too many (surplus) and
one too few (deficit) over all groups, so a depth-first search from a word follows only the counts its budget of one
each still allows, and the words at the leaves it reaches are verified letter by letter.

* Words are counted inside the tasks that read the texts (bounded tables, emitted when full), then summed.
* The top levels of all tries are the shards: (length, first counts).  Their depth is the least at which no shard
  is over ``SHARD_WORDS`` words; one that stays larger is cut into blocks.  A word asks its own shard, those
  one allowed step away in one direction (so each pair meets once), and the shards of words one longer.
* A task streams the sorted rows of its shards: first the words of a block, which make its trie, then the words
  that ask it, in bounded runs that go down the trie together.  Only verified pairs leave the task.
* Each word's nearest form is one aggregate; roots follow the forms by pointer doubling on written tables.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sliced, stored

MIN_LETTERS, MIN_TIMES, EVERY = 5, 3, 97
#: Group of a code point, and the order of the trie's levels (groups of frequent letters first).
GROUPS = 13
LEVELS = (10, 6, 12, 1, 11, 7, 0, 9, 4, 8, 5, 2, 3)
#: Words of a shard's block, of a leaf, and of a run of asking words; letters compared at a time.
SHARD_WORDS, LEAF_WORDS, RUN_WORDS, CELLS = 4_000, 64, 20_000, 4_000_000
#: Distinct words that a reading task holds before it hands them on.
TABLE_WORDS = 400_000
OWN, SAME, LONGER = 1, 2, 3

LETTERS = "".join(map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]))


# -- words --------------------------------------------------------------------

def doc_words(doc_id, text: str | None) -> Counter:
    """Lower-cased letter runs of a text with their occurrences; one run in ``EVERY`` has lost a letter."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in Counter(_RUNS((text or "").encode().lower().decode())).items():  # bytes methods know ASCII only
        h = zlib.crc32(word.encode(), start)
        if h % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


_RUNS = re.compile("[A-Za-zÀ-ÿ]+").findall


def _count(batches):
    total: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                         names=["word", "n"])
        total.clear()
        return out

    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for word, n in doc_words(doc_id, text).items():
                if len(word) >= MIN_LETTERS:
                    total[word] += n
        if len(total) >= TABLE_WORDS:
            yield flush()
    yield flush()


def word_counts(docs: DataFrame, least: int = MIN_TIMES) -> DataFrame:
    """(word, n) of the words with at least ``least`` occurrences over all documents."""
    return (docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


# -- shards -------------------------------------------------------------------

def group_count(word: Column, group: int) -> Column:
    letters = "".join(c for c in LETTERS if ord(c) % GROUPS == group)
    return F.length(word) - F.length(F.translate(word, letters, ""))


def shard_key(deltas, longer: int = 0) -> Column:
    """Key of the shard whose counts differ by ``deltas`` from those of ``word``, for words ``longer`` by so many."""
    counts = [group_count(F.col("word"), g) + d for g, d in zip(LEVELS, deltas)]
    return F.concat_ws(",", *[c.cast("string") for c in (F.length("word") + longer, *counts)])


def steps(depth: int) -> list[tuple[int, tuple[int, ...]]]:
    """(role, deltas): shards that a word asks, each pair of shards in one direction only."""
    def delta(*changes):
        out = [0] * depth
        for place, by in changes:
            out[place] += by
        return tuple(out)
    one = [delta((i, 1)) for i in range(depth)]
    swap = [delta((i, 1), (j, -1)) for i in range(depth) for j in range(i + 1, depth)]
    return ([(OWN, delta())] + [(SAME, d) for d in one + swap] + [(LONGER, d) for d in [delta(), *one]])


def _depth(words: DataFrame, shard_words: int) -> int:
    """Least number of trie levels at which no shard is larger than ``shard_words``, all of them if none is enough."""
    for depth in range(1, GROUPS):
        largest = words.groupBy(shard_key([0] * depth).alias("key")).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= shard_words:
            return depth
    return GROUPS


# -- trie ---------------------------------------------------------------------

_GROUP = np.arange(256) % GROUPS


def letter_matrix(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of their code points (all below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def count_matrix(letters: np.ndarray) -> np.ndarray:
    n = len(letters)
    flat = np.bincount((np.arange(n)[:, None] * GROUPS + _GROUP[letters]).ravel(), minlength=n * GROUPS)
    return flat.reshape(n, GROUPS)[:, LEVELS]


def one_edit(asked: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(asked, words) matrix: exactly one letter replaced, or one inserted where the words are one longer."""
    length = asked.shape[1]
    ahead = asked[:, None, :] == words[None, :, :length]
    if words.shape[1] == length:
        return ahead.sum(axis=2) == length - 1
    behind = asked[:, None, :] == words[None, :, 1:]
    # the words' letter in excess stands where the equal starts end: the rest must equal shifted by one
    equal = np.where(ahead.all(axis=2), length, ahead.argmin(axis=2))
    rest = np.where(behind.all(axis=2), length, behind[:, :, ::-1].argmin(axis=2))
    return equal + rest >= length


class Trie:
    """Words of one length by successive letter-group counts; nodes are ranges of the sorted words."""

    def __init__(self, words: list[str], start: int = 0):
        self.words, self.start = words, start
        self.letters = letter_matrix(words)
        self.counts = count_matrix(self.letters)
        self.order = np.lexsort(self.counts.T[::-1])
        self.sorted = self.counts[self.order]

    def near(self, asking: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places (asking, words) of all pairs one edit apart; asking words are as long or one shorter."""
        letters = letter_matrix(asking)
        counts = count_matrix(letters)
        found: list = []
        spent = np.zeros(len(asking), np.int8)
        self._descend(0, 0, len(self.words), np.arange(len(asking)), spent, spent, letters, counts, found)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _descend(self, level, low, high, asked, surplus, deficit, letters, counts, found):
        if high - low <= LEAF_WORDS or level == GROUPS:
            self._verify(low, high, asked, letters, found)
            return
        have, want = self.sorted[low:high, level], counts[asked, level]
        bounds = np.append(np.append(0, np.flatnonzero(np.diff(have)) + 1), high - low)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            more = want - have[a]
            over, under = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
            allowed = (over <= 1) & (under <= 1)
            if allowed.any():
                self._descend(level + 1, low + a, low + b, asked[allowed], over[allowed], under[allowed],
                              letters, counts, found)

    def _verify(self, low, high, asked, letters, found):
        length = self.letters.shape[1]
        width = max(1, min(high - low, CELLS // length))
        height = max(1, CELLS // (length * width))
        for a in range(low, high, width):
            members = self.order[a:min(a + width, high)]
            for b in range(0, len(asked), height):
                some = asked[b:b + height]
                i, j = np.nonzero(one_edit(letters[some], self.letters[members]))
                if len(i):
                    found.append((some[i], members[j]))


def _pairs(batches):
    """Verified pairs, both ways, of sorted rows (key, block, role, word, n): (word, near, near_n)."""
    shard, words, times, trie, run = None, [], [], None, []

    def ask():
        nonlocal trie
        if not run or not words:
            run.clear()
            return
        if trie is None:
            trie = Trie(words)
        i, j = trie.near([w for _, w, _ in run])
        left = [run[x] for x in i.tolist()]
        out = [(w, n, words[y], times[y]) for (role, w, n), y in zip(left, j.tolist()) if role != OWN or w < words[y]]
        run.clear()
        if out:
            a, na, b, nb = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()),
                                              pa.array(nb + na, pa.int64())], names=["word", "near", "near_n"])

    for batch in sliced(batches, 4096):
        for key, block, role, word, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (key, block) != shard:
                yield from ask()
                shard, trie = (key, block), None
                words, times = [], []
            if role == 0:
                words.append(word)
                times.append(n)
                continue
            if run and (len(run) >= RUN_WORDS or (run[-1][0] == LONGER) != (role == LONGER)):
                yield from ask()
            run.append((role, word, n))
    yield from ask()


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions.

    ``words`` is (word, n) with distinct words of letters below U+0100, on a table that can be read again.
    """
    spark = words.sparkSession
    depth = _depth(words, shard_words)
    keyed = words.withColumn("key", shard_key([0] * depth))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_words)).cast("int").alias("blocks"))
    sizes = stored(sizes, "spelling-shards")
    held = (keyed.join(sizes, "key").select("key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"),
                                            F.lit(0).alias("role"), "word", "n"))
    shards = [F.struct(F.lit(role).alias("role"), shard_key(d, int(role == LONGER)).alias("key")) for role, d in steps(depth)]
    asking = (words.select("word", "n", F.explode(F.array(*shards)).alias("s")).select("s.key", "s.role", "word", "n")
              .join(sizes, "key")
              .select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "role", "word", "n"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (held.unionByName(asking).repartition(n, "key", "block").sortWithinPartitions("key", "block", "role")
            .mapInArrow(_pairs, "word string, near string, near_n long"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, for the words that have one (chains at least double n a step)."""
    state = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = stored(state.join(ahead, "root", "left")
                       .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                       "spelling-roots")
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word with its spelling form.

    Words are lower-cased (A-Z) letter runs of whole texts, some with a letter lost by the rule of ``doc_words``,
    of at least ``MIN_LETTERS`` letters and ``MIN_TIMES`` occurrences.  Near words differ by one inserted, deleted or
    replaced letter.  ``form`` is the near word of largest n (ties: smallest) if that n is at least twice the
    word's, else null; ``root`` follows forms to the last.  Null and empty texts have no words; a null doc_id
    counts as an empty id; a very long run is one word; repeated rows count again; other columns are ignored; an
    empty table gives no rows.
    """
    words = stored(word_counts(docs), "spelling-words")
    best = (near_pairs(words, shard_words).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("b"))
            .select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n")))
    known = words.join(best, "word", "left")
    strong = F.col("near_n") >= 2 * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")),
                   "spelling-forms")
    roots = _roots(known.where(F.col("form").isNotNull()))
    return (known.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
