"""Vector helpers: array <-> numpy, exact block top-k kernel (used inside Arrow-batched tasks)."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd

#: score margin that keeps every row whose 6-decimal rounded score can tie the k-th best
TIE_MARGIN = 2e-6
SCORE_DECIMALS = 6
#: documents and queries whose scores are held at a time
TILE_ROWS = 512
TILE_QUERIES = 1024


def stack(series: pd.Series, dim: int | None = None) -> np.ndarray:
    """pandas Series of float arrays -> (n, d) float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def normalize_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    n[n == 0] = 1.0
    return m / n


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    counts = ends - starts
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return np.empty(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - counts), counts)


def half_up(scores: np.ndarray, decimals: int = 6) -> np.ndarray:
    """Scores rounded as Spark rounds doubles: half up (away from zero) on their shortest decimal form."""
    unit = 10.0 ** decimals
    scaled = np.abs(scores) * unit
    out = np.copysign(np.floor(scaled + 0.5), scores)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 * np.maximum(1.0, scaled * 1e-9)):
        out[i] = float(Decimal(repr(float(scores[i]))).scaleb(decimals).quantize(Decimal(1), ROUND_HALF_UP))
    return out / unit


class RunningTopK:
    """Per query, the documents seen so far that can still be in its exact top-k.

    Scores come in tiles of ``TILE_ROWS`` documents by ``TILE_QUERIES`` queries.  Each query has a floor, its k-th best score
    so far minus a tie margin: one comparison with it drops nearly all of a tile.  Kept are all documents at the floor or
    above, so the final ranking (rounded score desc, doc id asc) is unaffected by the cut; of documents with one and the
    same score only the ``k`` smallest ids.  At most about 2 * k rows a query are held.
    With ``max_score``, documents of that rounded score or more are left out before the cut.  ``excluded``
    ((document ids in order, query number of each)) lists pairs that take no part.  A second score can be held beside the
    first (``take``); it does not decide what is kept.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, exclude_self: bool = False,
                 max_score: float | None = None, excluded=None):
        self.qids, self.q, self.k, self.exclude_self, self.max_score = qids, q, k, exclude_self, max_score
        self.excluded = excluded
        self.floor = np.full(len(qids), -np.inf)
        self.parts: list[list] = [[] for _ in range(-(-len(qids) // TILE_QUERIES))]

    def tiles(self):
        """(first, end) of the query tiles."""
        return [(a, min(a + TILE_QUERIES, len(self.qids))) for a in range(0, len(self.qids), TILE_QUERIES)]

    def add(self, dids: np.ndarray, d: np.ndarray, second=None) -> None:
        self.score(dids, lambda rows, a, b: d[rows] @ self.q[a:b].T, second)

    def score(self, dids: np.ndarray, scores, second=None) -> None:
        """Documents by their tiles of scores: ``scores(rows, first, end)`` gives those of some rows and queries."""
        for low in range(0, len(dids), TILE_ROWS):
            rows = slice(low, min(low + TILE_ROWS, len(dids)))
            out = self._out(dids[rows])
            for a, b in self.tiles():
                self.take(dids[rows], scores(rows, a, b), a, None if second is None else (lambda r, c, low=low: second(r + low, c)), out)

    def _out(self, ids: np.ndarray):
        """(row, query number) of the excluded pairs of some documents."""
        if self.excluded is None:
            return None
        docs, queries = self.excluded
        low, high = np.searchsorted(docs, ids, "left"), np.searchsorted(docs, ids, "right")
        return np.repeat(np.arange(len(ids)), high - low), queries[ranges(low, high)]

    def take(self, ids: np.ndarray, s: np.ndarray, first: int = 0, second=None, out=None) -> None:
        """Documents with their scores (rows, queries from ``first``), which may be written over; ``second(row, query)``
        gives the second scores of some of them, ``out`` the excluded pairs of the rows."""
        end = first + s.shape[1]
        floor = self.floor[first:end]
        if out is not None:
            inside = (out[1] >= first) & (out[1] < end)
            s[out[0][inside], out[1][inside] - first] = -np.inf
        mask = s >= floor[None, :]
        if self.max_score is not None:
            mask &= s < self.max_score  # scores that round up to it are dropped below
        if s.shape[0] > self.k and np.isneginf(floor).any():
            allowed = mask & np.isfinite(s)
            if self.exclude_self:
                allowed &= ids[:, None] != self.qids[None, first:end]
            if self.max_score is not None:
                allowed &= np.round(s, SCORE_DECIMALS) < self.max_score
            kth = np.partition(np.where(allowed, s, -np.inf), s.shape[0] - self.k, axis=0)[s.shape[0] - self.k]
            np.maximum(floor, kth - TIE_MARGIN, out=floor)
            mask &= s >= floor[None, :]
        r, c = np.divmod(np.flatnonzero(mask), max(s.shape[1], 1))
        score = s[r, c]
        keep = np.isfinite(score)
        if self.exclude_self:
            keep &= ids[r] != self.qids[first + c]
        if self.max_score is not None:
            keep &= np.round(score, SCORE_DECIMALS) < self.max_score
        if not keep.all():
            r, c, score = r[keep], c[keep], score[keep]
        if not len(r):
            return
        tile = first // TILE_QUERIES
        if end > (tile + 1) * TILE_QUERIES:
            raise ValueError("scores of more than one tile of queries")
        c = c + first
        self.parts[tile].append((c.astype(np.int32), ids[r], score, second(r, c) if second is not None else None))
        if sum(len(p[0]) for p in self.parts[tile]) > 2 * self.k * (end - first):
            self._prune(tile)

    def _prune(self, tile: int) -> None:
        if not self.parts[tile]:
            return
        qi, di, sc, other = (None if x[0] is None else np.concatenate(x) for x in zip(*self.parts[tile]))
        key = di if di.dtype.kind in "iuf" else di.astype(str)
        order = np.lexsort((key, -sc, qi))
        qi, di, sc = qi[order], di[order], sc[order]
        new = np.r_[True, np.diff(qi) != 0]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], qi.size]
        kth = sc[np.minimum(starts + self.k, ends) - 1]
        full = ends - starts >= self.k
        at = qi[starts[full]]
        self.floor[at] = np.maximum(self.floor[at], kth[full] - TIE_MARGIN)
        tied = np.flatnonzero(new | np.r_[True, np.diff(sc) != 0])          # first row of each equal score
        place = np.arange(qi.size) - np.repeat(tied, np.diff(np.r_[tied, qi.size]))
        keep = (sc >= np.repeat(kth, ends - starts) - TIE_MARGIN) & (place < self.k)
        self.parts[tile] = [(qi[keep], di[keep], sc[keep], None if other is None else other[order][keep])]

    def result(self):
        """Three aligned arrays (query ids, doc ids, scores)."""
        for tile in range(len(self.parts)):
            self._prune(tile)
        found = [p[0] for p in self.parts if p]
        if not found:
            return self.qids[:0], np.array([], dtype=np.int64), np.array([], dtype=np.float64)
        qi, di, sc = (np.concatenate(x) for x in list(zip(*found))[:3])
        return self.qids[qi], di, sc

    def finished(self):
        """What a task emits."""
        return self.result()

    def ranked(self, k: int):
        """As ``result`` by the second scores: of each query's exact top (rounded score, then id) those that can be among
        its ``k`` best by the second score."""
        best = []
        for tile in range(len(self.parts)):
            self._prune(tile)
            for qi, di, sc, other in self.parts[tile]:
                key = di if di.dtype.kind in "iuf" else di.astype(str)
                order = np.lexsort((key, -half_up(sc), qi))
                qi, di, other = qi[order], di[order], other[order]
                starts = np.flatnonzero(np.r_[True, np.diff(qi) != 0])
                keep = np.arange(qi.size) - np.repeat(starts, np.diff(np.r_[starts, qi.size])) < self.k
                again = RunningTopK(self.qids, self.q, k)
                again.parts[tile] = [(qi[keep], di[keep], other[keep], None)]
                again._prune(tile)
                best += again.parts[tile]
        if not best:
            return self.qids[:0], np.array([], dtype=np.int64), np.array([], dtype=np.float64)
        qi, di, sc = (np.concatenate(x) for x in list(zip(*best))[:3])
        return self.qids[qi], di, sc


def block_topk(qids: np.ndarray, q: np.ndarray, dids: np.ndarray, d: np.ndarray, k: int, exclude_self: bool = False,
               max_score: float | None = None):
    """``RunningTopK`` over one block."""
    top = RunningTopK(qids, q, k, exclude_self, max_score=max_score)
    top.add(dids, d)
    return top.result()
