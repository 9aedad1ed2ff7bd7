"""Exact top-k inner products by best-first search in M-trees (Ciaccia, Patella and Zezula 1997).

Inner products become distances: a vector x gets one more component, sqrt(R^2 - |x|^2), where R is the largest
norm of the tree; then |x' - q'|^2 = R^2 + |q|^2 - 2 <x, q>. Each Arrow batch of vectors is a tree of pages with
pivots, covering radii and distances to the parent's pivot. A block of queries searches a tree together, the page
with the least possible distance first; stored parent distances rule out entries before any distance is computed.
A task carries each query's k best from tree to tree, so later trees are pruned from the start; Spark keeps the k
best of all tasks.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 16
PAGE = 48
NO_SCORE = -(1 << 63) + 1


def quantised(vectors: list, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and floor(scale * x) of those; shorter ones are filled with zeros."""
    good, rows = [], []
    for k, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            good.append(k)
            rows.append(np.floor(scale * x).astype(np.int64))
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return np.array(good, np.int64), out


class Page:
    """Entries of a node. ``below`` holds child pages, or None in a leaf, whose entries are vectors."""

    __slots__ = ("rows", "points", "to_parent", "radius", "below")

    def __init__(self, rows, points, to_parent, radius=None, below=None):
        self.rows, self.points, self.to_parent, self.radius, self.below = rows, points, to_parent, radius, below


class MTree:
    def __init__(self, vectors: np.ndarray):
        norms = (vectors * vectors).sum(axis=1)
        self.vectors = vectors
        self.top = int(norms.max(initial=0))
        self.points = np.column_stack([vectors, np.sqrt(self.top - norms)]).astype(np.float64)
        self._random = np.random.Generator(np.random.PCG64(11))
        self.root = self._page(np.arange(len(vectors)), None)

    def _far(self, rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - pivot) ** 2).sum(axis=1))

    def _page(self, rows: np.ndarray, parent: np.ndarray | None) -> Page:
        far = self._far(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            return Page(rows, self.points[rows], far)
        pivots = self._random.choice(rows, min(FANOUT, len(rows) // PAGE + 1), replace=False)
        near = np.stack([self._far(rows, self.points[p]) for p in pivots])
        home = near.argmin(axis=0)
        groups = [rows[home == g] for g in range(len(pivots))]
        if max(map(len, groups)) == len(rows):
            # the pivots don't part the rows: any even cut does
            groups = np.array_split(rows, len(pivots))
        kept = [g for g in range(len(pivots)) if len(groups[g])]
        points = self.points[pivots[kept]]
        below = [self._page(groups[g], p) for g, p in zip(kept, points, strict=True)]
        radius = np.array([self._far(groups[g], p).max() for g, p in zip(kept, points, strict=True)])
        to_parent = np.sqrt(((points - parent) ** 2).sum(axis=1)) if parent is not None else np.zeros(len(kept))
        return Page(None, points, to_parent, radius, below)

    def search(self, asked: np.ndarray, names: np.ndarray, ids: np.ndarray, best: "Best") -> int:
        """Put what this tree has for the queries ``asked`` into ``best``; returns how many distances were computed.

        The queries of a block go through the tree together, the page with the least possible distance to any of them
        first. A page is read for the queries that it can still serve, and skipped when there are none; a query whose
        k best of earlier trees are near already asks for few pages. Entries that stored parent distances rule out
        for all queries are left out before any distance is computed.
        """
        q = np.column_stack([asked, np.zeros(len(asked))]).astype(np.float64)
        own = (asked.astype(np.float64) ** 2).sum(axis=1)
        whole = self.top + own
        slack = 1e-9 * (1.0 + np.sqrt(whole) * 2)
        reach = best.reach(whole) + slack
        exact = np.abs(asked).max(initial=0) * float(np.abs(self.vectors).max(initial=0)) * max(1, self.vectors.shape[1]) < 1 << 52
        mine, theirs = (self.vectors.astype(np.float64), asked.astype(np.float64)) if exact else (self.vectors, asked)
        none = np.zeros(len(asked))
        pages: list = [(0.0, 0, self.root, none, None)]
        n = computed = 0
        while pages:
            _, _, page, least, to_query = heapq.heappop(pages)
            active = np.flatnonzero(least <= reach)
            if not len(active):
                continue
            maybe = np.arange(len(page.points))
            if to_query is not None:
                wide = 0.0 if page.below is None else page.radius
                near = np.abs(to_query[active, None] - page.to_parent) - wide <= reach[active, None]
                maybe = np.flatnonzero(near.any(axis=0))
                if not len(maybe):
                    continue
            computed += len(active) * len(maybe)
            if page.below is None:
                rows = page.rows[maybe]
                scores = (theirs[active] @ mine[rows].T).astype(np.int64)
                changed = best.offer(active, scores, ids[rows], names)
                reach[changed] = best.reach(whole)[changed] + slack[changed]
                continue
            points = page.points[maybe]
            far = np.sqrt(np.maximum(0.0, (q[active] ** 2).sum(axis=1)[:, None] - 2.0 * (q[active] @ points.T) + (points**2).sum(axis=1)))
            # the sum of squares rounds more coarsely than a difference would
            low = np.maximum(0.0, far - page.radius[maybe] - 1e-6 * (1.0 + np.sqrt(whole[active])[:, None]))
            wanted = low <= reach[active, None]
            for j in np.flatnonzero(wanted.any(axis=0)).tolist():
                bound, distance = np.full(len(asked), np.inf), np.zeros(len(asked))
                bound[active], distance[active] = np.where(wanted[:, j], low[:, j], np.inf), far[:, j]
                n += 1
                heapq.heappush(pages, (float(low[wanted[:, j], j].min()), n, page.below[maybe[j]], bound, distance))
        return computed


class Best:
    """The k best (score, id) of each query of a block, kept from tree to tree: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), NO_SCORE)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def reach(self, whole: np.ndarray) -> np.ndarray:
        """Distance of the k-th best; without one it is infinite."""
        last = self.scores[:, -1]
        return np.where(last == NO_SCORE, np.inf, np.sqrt(np.maximum(0.0, whole - 2.0 * last)))

    def offer(self, active: np.ndarray, scores: np.ndarray, ids: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Take over what is better; returns the queries that changed."""
        scores[names[active][:, None] == ids[None, :]] = NO_SCORE
        better = (scores >= self.scores[active, -1:]) & (scores > NO_SCORE)
        some = np.flatnonzero(better.any(axis=1))
        if len(some):
            at = active[some]
            both = np.concatenate([self.scores[at], scores[some]], axis=1)
            who = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
            order = np.lexsort((who, -both), axis=1)[:, : self.scores.shape[1]]
            self.scores[at], self.ids[at] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        return active[some]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block_queries: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``vectors`` with the highest integer inner products.

    Both have vec_id, embedding; components become floor(scale * x). A query's own vec_id is no candidate.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
    shorter vectors count as filled with zeros. Of several queries with one vec_id one is asked. Queries go
    to the tasks in blocks of about ``block_queries``, every block against all vectors. Extra columns are ignored.
    """
    queries = queries.select("vec_id", "embedding").dropna().dropDuplicates(["vec_id"])
    vectors = vectors.select("vec_id", "embedding").dropna()
    n_blocks = max(1, -(-queries.count() // block_queries))  # one number
    out = None
    for block in range(n_blocks):
        some = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).orderBy("vec_id").toArrow()
        good, asked = quantised(some.column("embedding").to_pylist(), scale)
        names = some.column("vec_id").to_numpy()[good] if len(good) else np.zeros(0, np.int64)

        def search(batches: Iterator[pa.RecordBatch], asked=asked, names=names) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), k)
            for b in batches:
                good, mine = quantised(b.column(1).to_pylist(), scale)
                if len(good) and len(names):
                    ids = b.column(0).to_numpy()[good].astype(np.int64)
                    width = max(mine.shape[1], asked.shape[1])
                    mine = np.pad(mine, ((0, 0), (0, width - mine.shape[1])))
                    ask = np.pad(asked, ((0, 0), (0, width - asked.shape[1])))
                    # of equal vectors only the k + 1 smallest ids can be among the k best of any query
                    order = np.lexsort((ids, *mine.T[::-1])) if width else np.argsort(ids)
                    same = np.concatenate([[False], (mine[order][1:] == mine[order][:-1]).all(axis=1)])
                    place = np.arange(len(order))
                    first = np.maximum.accumulate(np.where(same, 0, place))
                    order = order[place - first <= k]
                    ids, tree = ids[order], MTree(mine[order])
                    tree.search(ask, names, ids, best)
            query, rank = np.nonzero(best.scores > NO_SCORE)
            columns = (names[query], best.ids[query, rank], best.scores[query, rank])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(search, "query_id long, vec_id long, score long")
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
