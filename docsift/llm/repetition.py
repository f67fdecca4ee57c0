"""Quality rules on repetition inside a text, by a suffix array over its words.

The words of a slice of documents are numbered apart for every document and laid end to end, so one suffix
array serves the slice and no repeat joins two documents.  It is built by prefix doubling: ranks by the first
1, 2, 4, ... words, where only suffixes that still share a rank are sorted again, so ordinary prose ends after a
few rounds.  The ranks of all rounds give the longest common prefix (LCP) of neighbouring suffixes.

An LCP interval (a run of suffixes with a common prefix of some length, longest possible on both sides) whose
occurrences are preceded by different words is a maximal repeated substring.  The union of the spans of all
maximal repeats of at least ``least`` words is the covered part of a text.  A text passes if the covered share of
its words and its longest repeat stay within the limits.

Every document is judged on its own: no shuffle, and a task holds the arrays of one slice of about
``SLICE_WORDS`` words, or of one longer text, at a time (some tens of bytes a word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import sliced

#: Words of a repeat that counts, share of the words that repeats may cover, and words of the longest repeat allowed.
LEAST_WORDS, MAX_COVERED, MAX_REPEAT = 5, 0.30, 200
#: Words of the windows behind ``n_repeat_words``.
WINDOW = 3
#: Words of the documents that share a suffix array.
SLICE_WORDS = 150_000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_covered long, longest_repeat long, n_maximal long")
REPEATS = "doc_id long, first_word long, n_words long, n_times long, words string"


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes in sorted order, and the common prefix of each (from the second) with the one before."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[order][1:] != symbols[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, step = [], 1
    while True:
        alone = first & np.append(first[1:], True)
        shared = np.flatnonzero(~alone)  # places of suffixes whose first ``step`` words are no other's
        if not len(shared):
            break
        ranks.append(rank.astype(np.int32))
        at = order[shared]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[shared], key = at[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        first[shared] = new
        rank[order[shared]] = shared[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        step *= 2
    lcp = np.zeros(max(n - 1, 0), np.int64)
    if ranks:
        likely = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
        a, b = order[likely], order[likely + 1]
        length = np.zeros(len(likely), np.int64)
        for k in reversed(range(len(ranks))):
            x, y = a + length, b + length
            inside = (x < n) & (y < n)
            same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
            length[same] += 1 << k
        lcp[likely] = length
    return order, lcp


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, low, high): LCP intervals ``order[low..high]`` of at least ``least`` whose occurrences differ before."""
    before = np.where(order > 0, symbols[order - 1], -1)
    change = np.append(0, np.cumsum(before[1:] != before[:-1]))
    out, stack = [], []

    def close(length, low, high):
        if change[high] > change[low]:
            out.append((length, low, high))

    last = None
    for i in np.flatnonzero(lcp >= least).tolist():
        if last is not None and i != last + 1:
            while stack:
                close(*stack.pop(), last + 1)
        low, here = i, int(lcp[i])
        while stack and stack[-1][0] > here:
            length, low = stack.pop()
            close(length, low, i)
        if not stack or stack[-1][0] < here:
            stack.append((here, low))
        last = i
    while stack:
        close(*stack.pop(), last + 1)
    return out


def covered(order: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeated substring of at least ``least`` words.

    The longest repeat that starts at a word is its suffix's longer common prefix with a neighbour, and the spans
    of these make the same union as those of all maximal repeats.
    """
    n = len(order)
    reach = np.zeros(n, np.int64)
    if n > 1:
        both = np.maximum(np.append(lcp, 0), np.append(0, lcp))
        reach[order] = both
    starts = np.flatnonzero(reach >= least)
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + reach[starts], minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _counts(text: str) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)))


def _slices(batches):
    """Runs of (doc_id, text, words) with about ``SLICE_WORDS`` words."""
    run, size = [], 0
    for batch in sliced(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().split()  # bytes methods know the ASCII blanks only
            run.append((doc_id, text or "", words))
            size += len(words)
            if size >= SLICE_WORDS:
                yield run
                run, size = [], 0
    if run:
        yield run


def _numbered(run) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers that differ between documents, and the document of each word."""
    numbers: dict = {}
    known = np.array([numbers.setdefault(w, len(numbers)) for _, _, words in run for w in words], np.int64)
    owner = np.repeat(np.arange(len(run)), [len(words) for _, _, words in run])
    return owner * (len(numbers) + 1) + known, owner


def _measure(least: int):
    def task(batches):
        for run in _slices(batches):
            symbols, owner = _numbered(run)
            order, lcp = suffix_array(symbols)
            longest, maximal = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
            for length, low, _ in maximal_repeats(symbols, order, lcp, least):
                doc = owner[order[low]]
                maximal[doc] += 1
                longest[doc] = max(longest[doc], length)
            repeated, spans = (np.bincount(owner[covered(order, lcp, m)], minlength=len(run)) for m in (WINDOW, least))
            base = np.array([_counts(text) for _, text, _ in run], np.int64).reshape(len(run), 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _, _ in run], pa.int64()), pa.array([len(w) for _, _, w in run], pa.int64()),
                 *[pa.array(base[:, i]) for i in range(3)], *[pa.array(x, pa.int64()) for x in (repeated, spans, longest, maximal)]],
                names=[c.split()[0] for c in SCHEMA.split(", ")])
    return task


def _listed(least: int):
    def task(batches):
        for run in _slices(batches):
            symbols, owner = _numbered(run)
            starts = np.append(0, np.cumsum([len(words) for _, _, words in run]))
            order, lcp = suffix_array(symbols)
            for length, low, high in maximal_repeats(symbols, order, lcp, least):
                doc_id, _, words = run[owner[order[low]]]
                first = int(order[low:high + 1].min() - starts[owner[order[low]]])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id], pa.int64()), "first_word": [first], "n_words": [length],
                     "n_times": [high - low + 1], "words": [b" ".join(words[first:first + length]).decode()]})
    return task


def maximal_repeat_rows(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, first_word, n_words, n_times, words): every maximal repeat of at least ``least`` words.

    ``first_word`` is the place of the first occurrence (from 0); occurrences may overlap.  Nulls and empty texts
    have none, rows with one doc_id are listed each, other columns are ignored, an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_listed(least), REPEATS)


def repetition_rules(docs: DataFrame, least: int = LEAST_WORDS, max_covered: float = MAX_COVERED,
                     max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per document: the base counts, what repeats cover, and the verdict.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in ``WINDOW``-word windows found again),
    n_covered (words in repeats of at least ``least``), longest_repeat, n_maximal (maximal repeats), base_failed,
    kept.  ``kept`` is false where the base rules fail, where repeats cover more than ``max_covered`` of the words
    or one is longer than ``max_repeat`` words.  A null or empty text has no words and fails the base rules.  A very
    long text is measured whole, in a suffix array of its own.  Every row is judged for itself, so repeated rows and
    null ids come back as they are; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure(least), SCHEMA)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    repeats = (F.col("n_covered") > F.lit(max_covered) * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeats)
