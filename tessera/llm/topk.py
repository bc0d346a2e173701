"""Exact top-k by integer inner product with block-at-a-time pruning.

Components are terms with weights floor(1024 x). Rows are ordered so that like rows stand
together and cut into document ranges; each range keeps a forward index (the rows' weights)
and the largest and smallest weight of each term. For one query the bound of a range is the
sum over terms of the larger of weight x maximum and weight x minimum. Ranges are scored in
order of their bounds until a bound falls below the k-th best score so far.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_distinct, search, usable

SCALE = 1024
RANGE_ROWS = 64
_EXACT = float(1 << 53)


def quantize(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(float))


class RangeIndex:
    """Document ranges of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, range_rows: int = RANGE_ROWS):
        weights = quantize(vectors)
        strongest = np.abs(weights).argmax(axis=1)
        strength = weights[np.arange(len(ids)), strongest]
        order = np.lexsort((strength, strongest))  # rows led by the same term stand together
        self.ids, self.weights, self.place, self.k = ids[order], weights[order], order, k
        self.starts = np.arange(0, len(ids), range_rows)
        self.ends = np.append(self.starts[1:], len(ids))
        self.high = np.maximum.reduceat(self.weights, self.starts, axis=0)
        self.low = np.minimum.reduceat(self.weights, self.starts, axis=0)
        self.largest = np.abs(self.weights).max(initial=0) * self.weights.shape[1]
        self.scored = 0  # ranges, for tests

    def _whole(self, own: int, query: np.ndarray) -> tuple[list[int], list[int]]:
        """Weights beyond 2^53 in total: Python integers, every range, clipped to 64 bits."""
        asked = [int(x) for x in query]
        scores = [sum(int(w) * a for w, a in zip(row, asked, strict=True)) for row in self.weights.tolist()]
        best = best_distinct(self.ids, sorted(range(len(scores)), key=lambda i: (-scores[i], self.ids[i])), own, self.k)
        return best, [max(-(1 << 63), min((1 << 63) - 1, scores[i])) for i in best]

    def _pruned(self, own: int, query: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[int]]:
        best_rows, best_scores, best_ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, self.ids.dtype)
        kth = -np.inf
        for at in np.argsort(-bounds, kind="stable"):
            if bounds[at] < kth:
                break
            self.scored += 1
            start, end = self.starts[at], self.ends[at]
            scores = self.weights[start:end] @ query
            keep = np.flatnonzero(scores >= kth)
            if not len(keep):
                continue
            rows = np.concatenate([best_rows, start + keep])
            scores = np.concatenate([best_scores, scores[keep]])
            names = np.concatenate([best_ids, self.ids[start + keep]])
            pick = best_distinct(names, np.lexsort((names, -scores)), own, self.k)
            best_rows, best_scores, best_ids = rows[pick], scores[pick], names[pick]
            if len(pick) == self.k:
                kth = best_scores[-1]
        return best_rows.tolist(), best_scores.astype(np.int64).tolist()

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray):
        asked = quantize(queries)
        exact = self.largest * np.abs(asked).max(axis=1, initial=0) < _EXACT
        safe = np.where(exact[:, None], asked, 0)
        bounds = np.maximum(safe, 0) @ self.high.T + np.minimum(safe, 0) @ self.low.T if exact.any() else np.zeros((len(asked), len(self.starts)))
        out_q, out_r, out_s = [], [], []
        for i, own in enumerate(query_ids):
            rows, scores = self._pruned(own, asked[i], bounds[i]) if exact[i] else self._whole(own, asked[i])
            out_q += [i] * len(rows)
            out_r += rows
            out_s += scores
        return np.array(out_q, np.int64), self.place[np.array(out_r, np.int64)], np.array(out_s, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, block_rows: int | None = None) -> DataFrame:
    """The k rows of highest integer inner product for each query row, exactly: query_id, rank, id, score long.

    Rows whose id or vector is null or whose vector holds a null or non-finite component take no part
    (zero vectors do); ties go to the smaller id; repeated rows count once; a query is compared with
    rows of its own length; scores beyond 64 bits are clipped to them; other columns are not read.
    """
    rows, asked = usable(vectors, id_col, vec_col, zero=True), usable(queries, id_col, vec_col, zero=True)
    return search(rows, asked, lambda ids, v: RangeIndex(ids, v, k), k, "long", F.desc("score"), block_rows)
