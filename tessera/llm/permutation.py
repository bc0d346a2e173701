"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order of distance. Each block posts its
vectors in one inverted file per pivot, with the pivot's position in the vector's order.
A query walks the files of its own pivots and sums, for each vector met, how well the
positions agree. Orders are prefixes, a sixteenth of all pivots, so a file holds a small part of the rows and most
rows are in few of the files that a query walks. This ranks vectors by the footrule distance of the two orders, where a
pivot that an order lacks counts as standing at its end. The best-ranked vectors are then
reranked by their true distance.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best_distinct, search, usable

PIVOTS = 512  # a bounded sample: the rows first by hash of the id
PREFIX = 32  # nearest pivots in a vector's order: a vector is in so many files, and a query walks so many
SHARE = 0.3  # of a block's vectors so many are reranked, and at least k and the query itself
_ORDER_ROWS = 4096  # rows whose orders are found at once


def pick_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Vectors of the most common length among a bounded sample, repeated ones once."""
    sample = [tuple(r["__vec"]) for r in rows.orderBy(F.xxhash64("__id"), "__id", "__vec").limit(4 * pivots).collect()]
    lengths = [len(v) for v in sample]
    common = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    chosen = list(dict.fromkeys(v for v in sample if len(v) == common))[:pivots]
    return np.array(chosen, float).reshape(len(chosen), common)


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to the smaller pivot."""
    if len(vectors) > _ORDER_ROWS:
        return np.concatenate([orders(vectors[at : at + _ORDER_ROWS], pivots, prefix) for at in range(0, len(vectors), _ORDER_ROWS)])
    far = ((vectors[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2) if len(vectors) * pivots.size < 2_000_000 else None
    if far is None:
        scale = max(1.0, float(np.abs(vectors).max(initial=0)), float(np.abs(pivots).max(initial=0)))
        v, p = vectors / scale, pivots / scale
        far = (v * v).sum(axis=1)[:, None] - 2 * v @ p.T + (p * p).sum(axis=1)
    return np.argsort(far, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class PivotFiles:
    """The inverted files of one block: of each pivot, the rows that have it in their order and where.
    A file that holds every row is kept as their positions alone."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int, k: int, share: float):
        self.ids, self.vectors, self.pivots, self.k = ids, vectors.astype(float), pivots, k
        _, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        self.repeated = bool(counts.max(initial=1) > 1)
        self.comparable = len(pivots) > 0 and pivots.shape[1] == vectors.shape[1]  # other lengths are all compared
        # k and the query itself, and the further rows that equal ids take of the set
        least = k + 1 + int(np.sort(counts - 1)[-(k + 1) :].sum()) if self.repeated else k + 1
        self.reranked = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
        self.met = 0  # rows met in files, for tests
        if self.comparable:
            self.prefix = min(prefix, len(pivots))
            order = orders(self.vectors, pivots, self.prefix)
            pivot, row = order.ravel(), np.repeat(np.arange(len(ids), dtype=np.int32), self.prefix)
            by_pivot = np.argsort(pivot, kind="stable")
            position = (by_pivot % self.prefix).astype(np.int16)
            cuts = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
            self.files = [(None if b - a == len(ids) else row[by_pivot[a:b]], position[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _candidates(self, order: np.ndarray) -> np.ndarray:
        agreement = np.zeros(len(self.ids), np.int32)
        for position, pivot in enumerate(order.tolist()):
            rows, positions = self.files[pivot]
            self.met += len(positions)
            # against footrule terms of a pivot that only one order has: 2 * (end - later of both)
            gain = np.int16(self.prefix) - np.maximum(positions, np.int16(position))
            if rows is None:
                agreement += gain
            else:
                agreement[rows] += gain
        return np.argpartition(-agreement, self.reranked - 1)[: self.reranked]

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray):
        everyone = np.arange(len(self.ids))
        routes = orders(queries.astype(float), self.pivots, self.prefix) if self.comparable else [None] * len(queries)
        out_q, out_r, out_s = [], [], []
        for i, (own, query, order) in enumerate(zip(query_ids, queries.astype(float), routes, strict=True)):
            near = self._candidates(order) if self.comparable else everyone
            score = np.sqrt(((self.vectors[near] - query) ** 2).sum(axis=1))
            if len(near) > 4 * self.k and not self.repeated:
                edge = np.partition(score, self.k)[self.k]  # k and the query itself; ties at the edge stay
                keep = score <= edge
                near, score = near[keep], score[keep]
            ranked = np.lexsort((self.ids[near], score))
            best = best_distinct(self.ids[near], ranked, own, self.k)
            out_q += [i] * len(best)
            out_r += near[best].tolist()
            out_s += score[best].tolist()
        return np.array(out_q, np.int64), np.array(out_r, np.int64), np.array(out_s, float)


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, block_rows: int | None = None
) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, id, score (Euclidean, double).

    Every row is indexed and every block is asked, so each query gets k rows where there are
    as many. share=1 reranks all rows and is exact. Rows whose id or vector is null, whose vector is
    zero or holds a null or non-finite component take no part; ties go to the smaller id; repeated
    rows count once; a query is compared with rows of its own length; other columns are not read.
    """
    rows, asked = usable(vectors, id_col, vec_col, zero=False), usable(queries, id_col, vec_col, zero=False)
    shared = vectors.sparkSession.sparkContext.broadcast(pick_pivots(rows, pivots))
    return search(rows, asked, lambda ids, v: PivotFiles(ids, v, shared.value, prefix, k, share), k, "double", F.asc("score"), block_rows)
