"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over labelled text.  A text is parsed greedily into the longest
phrases that occur in the training text; the language that needs the fewest phrases a character wins.

The automata come from a bounded sample of labelled rows: per language the ``SAMPLE_DOCS`` texts of least md5(doc_id),
up to ``TRAIN_CHARS`` characters in all.  Texts of ``MIN_CHARS`` to ``MAX_CHARS`` characters come first; others, long
ones cut to ``MAX_CHARS``, fill the places that these leave.  Where so many texts stay below ``TRAIN_CHARS``, as many
more are taken as it needs at their mean length.

Every automaton has the letters of its own sample as alphabet.  Its ``SYMBOLS`` most frequent ones move through a
dense table, the others through a sorted list of (state, letter); both are broadcast.  They are bounded by
2 * TRAIN_CHARS states of SYMBOLS four-byte entries and 3 * TRAIN_CHARS listed moves a language.
Tasks parse many texts in step: every text is cut into blocks of ``BLOCK`` symbols, a phrase ends at its block's
end, and one numpy operation moves all blocks of a batch by one symbol.  Whole texts are parsed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.llm.common import sliced

SAMPLE_DOCS = 64
MIN_CHARS, MAX_CHARS = 100, 20_000
TRAIN_CHARS = 30_000
SYMBOLS = 48
BLOCK = 512
#: Blocks moved together; bounds a task's arrays.
LANES = 16_384
UNKNOWN = "und"
GAP = " "


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def normalise(text: str) -> str:
    """Lower-cased letters, everything between words as one gap."""
    return GAP.join("".join(c if c.isalpha() else GAP for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Moves {symbol: state} out of every state of the automaton of all substrings; state 0 is dead, state 1 the start."""
    step: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """Suffix automaton of a normalised text over its own letters; symbol 0 is any other letter, 1 the gap."""

    def __init__(self, text: str):
        letters = sorted(Counter(text.replace(GAP, "")).items(), key=lambda x: (-x[1], x[0]))
        self.codes = {GAP: 1} | {c: i for i, (c, _) in enumerate(letters, 2)}
        self.width = len(self.codes) + 1
        step = suffix_automaton([self.codes[c] for c in text])
        self.table = np.zeros((len(step), SYMBOLS), np.int32)
        self.start = np.zeros(self.width, np.int32)
        rare = []
        for state, moves in enumerate(step):
            for c, to in moves.items():
                if state == 1:
                    self.start[c] = to
                if c < SYMBOLS:
                    self.table[state, c] = to
                else:
                    rare.append((state * self.width + c, to))
        rare.sort()
        self.keys = np.array([k for k, _ in rare], np.int64)
        self.to = np.array([to for _, to in rare], np.int32)

    def count(self, lanes: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of every lane of symbols; ``active`` lanes are left in each row."""
        table = self.table.reshape(-1)
        listed = len(self.keys) and lanes.max(initial=0) >= SYMBOLS
        counts = np.zeros(lanes.shape[1], np.int32)
        state = np.full(lanes.shape[1], 1, np.int64)
        for row, n in zip(lanes, active):
            c, s = row[:n], state[:n]
            if listed:
                far = np.flatnonzero(c >= SYMBOLS)
                to = table[s * SYMBOLS + np.where(c < SYMBOLS, c, 0)]
                key = s[far] * self.width + c[far]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[far] = np.where(self.keys[at] == key, self.to[at], 0)
            else:
                to = table[s * SYMBOLS + c]
            miss = to == 0
            counts[:n] += miss
            state[:n] = np.maximum(np.where(miss, self.start[c], to), 1)
        return counts + 1  # the phrase that the block's end closes


class Parser:
    """Automata of all languages; counts phrases of many texts at once."""

    def __init__(self, samples: dict[str, list[str]], train_chars: int = TRAIN_CHARS):
        texts = {lang: GAP.join(map(normalise, rows))[:train_chars] for lang, rows in sorted(samples.items())}
        texts = {lang: t for lang, t in texts.items() if t.strip()}
        self.langs = list(texts)
        self.automata = [Automaton(t) for t in texts.values()]
        letters = sorted(set().union(*(a.codes for a in self.automata)) - {GAP})
        self.codes = {GAP: 1} | {c: i for i, c in enumerate(letters, 2)}  # 0: a letter of no automaton
        self.own = np.zeros((len(self.langs), len(self.codes) + 1), np.int32)  # code -> symbol of each automaton
        for own, automaton in zip(self.own, self.automata):
            for c, symbol in automaton.codes.items():
                own[self.codes[c]] = symbol
        # a longer sample has longer matches: phrases cost the bits of a place in the sample, which makes samples of
        # different length comparable
        self.cost = np.array([np.log2(len(t) + 2) for t in texts.values()])
        self._lookup = None

    def lookup(self) -> np.ndarray:
        """Code of every code point; -1 for what is no letter."""
        if self._lookup is None:
            table = np.full(0x110000, -1, np.int32)
            for first in range(0, 0x110000, 4096):
                for c in range(first, first + 4096):
                    if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                        table[c] = self.codes.get(chr(c), 0)
            self._lookup = table
        return self._lookup

    def __getstate__(self):
        return self.__dict__ | {"_lookup": None}

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text, each run of other characters as one gap, none at the ends; empty without letters."""
        raw = self.lookup()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        gap = raw < 0
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        out = np.where(gap, 1, raw)[keep]
        return out[int(gap[0]): len(out) - int(gap[-1])] if len(raw) and not gap.all() else np.empty(0, np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(len(texts), languages): phrases of each text by each language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        blocks = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), BLOCK)]
        blocks.sort(key=lambda b: -min(BLOCK, len(texts[b[0]]) - b[1]))
        for first in range(0, len(blocks), LANES):
            part = blocks[first:first + LANES]
            lengths = np.array([min(BLOCK, len(texts[i]) - at) for i, at in part])
            lanes = np.zeros((lengths[0], len(part)), np.int32)
            for lane, (i, at) in enumerate(part):
                lanes[:lengths[lane], lane] = texts[i][at:at + BLOCK]
            active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
            owner = np.array([i for i, _ in part])
            for lang, automaton in enumerate(self.automata):
                out[:, lang] += np.bincount(owner, automaton.count(self.own[lang][lanes], active), len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 - least / second least cost of its phrases, 1 for a single language.

        A phrase costs log2 of the length of the language's sample.
        """
        codes = [self.encode(t) if t else np.empty(0, np.int32) for t in texts]
        counts = self.phrases(codes)
        langs, scores = [], []
        for symbols, n in zip(codes, counts):
            if not len(symbols) or not self.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            n = n * self.cost
            order = np.argsort(n, kind="stable")
            langs.append(self.langs[order[0]])
            scores.append(1.0 - n[order[0]] / n[order[1]] if len(order) > 1 else 1.0)
        return langs, scores


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, train_chars: int = TRAIN_CHARS) -> Parser:
    """Parser from a bounded sample of (doc_id, text, lang) rows; null languages and texts are left out."""
    fits = F.length("text").between(MIN_CHARS, MAX_CHARS)
    usable = (labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
              .select("lang", "text", fits.alias("fits"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key")))
    order = Window.partitionBy("lang").orderBy(F.col("fits").desc(), "key", "text")

    def first(rows: DataFrame, n: int) -> dict[str, list[tuple]]:
        got: dict[str, list[tuple]] = {}
        for r in (rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
                  .select("lang", "n", F.substring("text", 1, MAX_CHARS).alias("text")).toLocalIterator()):  # bounded: n texts a language
            got.setdefault(r["lang"], []).append((r["n"], r["text"]))
        return got

    samples = first(usable, sample_docs)
    chars = {lang: len(GAP.join(normalise(t) for _, t in x)) for lang, x in samples.items()}
    short = {lang: -(-train_chars * len(x) // max(chars[lang], 1)) for lang, x in samples.items()
             if len(x) == sample_docs and chars[lang] < train_chars}
    if short:  # at most train_chars texts a language, of train_chars characters at their mean length
        samples |= first(usable.where(F.col("lang").isin(list(short))), min(max(short.values()), train_chars))
    return Parser({lang: [t for _, t in sorted(x)] for lang, x in samples.items()}, train_chars)


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only ``text`` is read for the prediction.

    Null texts, texts without letters, and all texts if nothing was learned, are ``und`` with score 0.  Ties go to
    the first language in name order.  Repeated rows each get a result; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        for batch in sliced(batches, 2048):
            langs, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))
