"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks.  Features of a block are the tags, classes, ids and roles above it and bins of its
text (words, link share, punctuation, signs); neighbouring labels are tied by transition weights.  The field is
trained by stochastic gradient on the exact log-likelihood (forward-backward) of labelled pages, and decoded by
Viterbi.  Training pages are generated, a fixed number; extraction is one map-side pass over all pages.
"""

from __future__ import annotations

import functools
import math
import random

import pyarrow as pa
from pyspark.sql import DataFrame

from docsift.llm.common import sliced
from docsift.llm.html_pages import blocks, labelled_pages

TRAIN_PAGES = 500
EPOCHS = 6
MEMO = 100_000


def _bin(x: float) -> int:
    return int(math.log2(x + 1))


def features(block) -> tuple[str, ...]:
    """Ancestor and text features of a leaf block."""
    text, above, inner, linked = block
    words = text.count(" ") + 1
    return (*above, "in:" + inner, f"words:{_bin(words)}", f"link:{min(linked * 4 // len(text), 4)}",
            f"end:{text[-1] in '.!?:;,…'}", f"marks:{min(sum(map(text.count, '.,;')) * 8 // words, 4)}",
            f"c:{'©' in text}", f"in:{inner}:{min(_bin(words), 4)}")


class Field:
    """Two-label chain; a feature's weight is its evidence for main text."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        self.start = [0.0, 0.0]
        self.memo: dict[tuple, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def score(self, feats: tuple[str, ...]) -> float:
        got = self.memo.get(feats)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            got = self.memo[feats] = sum(self.weights.get(f, 0.0) for f in feats)
        return got

    def train(self, pages, epochs: int = EPOCHS, seed: int = 3) -> "Field":
        """``pages``: lists of (features, label)."""
        rng, n = random.Random(seed), 0
        pages = [p for p in pages if p]
        for _ in range(epochs):
            for page in rng.sample(pages, len(pages)):
                n += 1
                self._learn([f for f, _ in page], [y for _, y in page], 0.3 / (1 + n / (2 * len(pages))))
                self.memo.clear()
        return self

    def _learn(self, feats, labels, rate) -> None:
        node, pair = self.marginals(feats)
        for f, y, p in zip(feats, labels, node):
            for name in f:
                old = self.weights.get(name, 0.0)
                self.weights[name] = old + rate * (y - p - 1e-4 * old)
        self.start[labels[0]] += rate
        for y in (0, 1):
            self.start[y] -= rate * (node[0] if y else 1 - node[0])
        for a, b, p in zip(labels, labels[1:], pair):
            for i in (0, 1):
                for j in (0, 1):
                    self.step[i][j] += rate * (((i, j) == (a, b)) - p[i][j])

    def marginals(self, feats):
        """P(main text) of every block, and of every pair of neighbouring labels, by forward-backward."""
        s = [(0.0, self.score(f)) for f in feats]
        forward = [[self.start[y] + s[0][y] for y in (0, 1)]]
        for e in s[1:]:
            last = forward[-1]
            forward.append([e[y] + _add(last[0] + self.step[0][y], last[1] + self.step[1][y]) for y in (0, 1)])
        backward = [[0.0, 0.0]]
        for e in reversed(s[1:]):
            nxt = backward[-1]
            backward.append([_add(self.step[y][0] + e[0] + nxt[0], self.step[y][1] + e[1] + nxt[1]) for y in (0, 1)])
        backward.reverse()
        total = _add(*forward[-1])
        node = [math.exp(f[1] + b[1] - total) for f, b in zip(forward, backward)]
        pair = [[[math.exp(forward[k][i] + self.step[i][j] + s[k + 1][j] + backward[k + 1][j] - total) for j in (0, 1)]
                 for i in (0, 1)] for k in range(len(s) - 1)]
        return node, pair

    def decode(self, feats) -> list[int]:
        """Most likely labels (Viterbi); ties go to label 0."""
        if not feats:
            return []
        best, back = [self.start[0], self.start[1] + self.score(feats[0])], []
        for f in feats[1:]:
            came = [0 if best[0] + self.step[0][y] >= best[1] + self.step[1][y] else 1 for y in (0, 1)]
            best = [best[came[0]] + self.step[came[0]][0], best[came[1]] + self.step[came[1]][1] + self.score(f)]
            back.append(came)
        labels = [0 if best[0] >= best[1] else 1]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def _add(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def labelled_blocks(page: str, labels) -> list[tuple[tuple[str, ...], int]]:
    """Features and label of every block of a labelled page."""
    return [(features(b), y) for b, (_, y) in zip(blocks(page), labels, strict=True)]


@functools.lru_cache(maxsize=1)
def trained(n_pages: int = TRAIN_PAGES) -> Field:
    return Field().train([labelled_blocks(*p) for p in labelled_pages(n_pages)])


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page) if page else []
    return " ".join(b[0] for b, y in zip(found, field.decode([features(b) for b in found])) if y)


def extract_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without main text, give an empty text.  Broken markup is read as far as it goes.
    Repeated rows each get a result; an empty table gives none; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        for batch in sliced(batches):
            texts = [main_text(h, shared.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
