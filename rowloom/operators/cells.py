"""Pivot cells: points grouped around pivots with radii, so that the triangle inequality rules out most of them.

A point at distance r of a pivot is at least |d - r| away from a query at distance d of it. A block of points whose radii
lie in [low, high] can therefore be left alone once the k-th neighbour found so far is nearer than that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from rowloom.functions.vectors import distance_error, paired_squares, squared_distances

DISTANCE_DIGITS = 9  # squared distances equal to this many digits are ties; the smaller key comes first
BLOCK_CELLS = 1 << 22
PAIRS_AT_ONCE = 1 << 18
#: Points of a block: near pivots' points are cut into rings of about so many.
RING_ROWS = 192
#: Queries that still need more than this share of the blocks are compared with all points.
DENSE = 0.5
#: Up to this width distances to pivots are summed from direct differences, which need almost no slack.
DIRECT_WIDTH = 32


def nearest(queries: np.ndarray, points: np.ndarray, k: int, categories: int = 0) -> tuple[np.ndarray, ...]:
    """Indices, rounded squared distances and exact distances of the k nearest points per query, over all pairs.

    Points must come in key order: equal distances then resolve to the smaller key by position. The product form only
    picks candidates: whatever its error could hide among the nearest is measured again by direct differences.
    """
    n, k = len(queries), min(k, len(points))
    index, rounded, distance = np.empty((n, k), np.int64), np.empty((n, k)), np.empty((n, k))
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    for start in range(0, n, step):
        block = queries[start : start + step]
        d2 = squared_distances(block, points, categories)
        slack = 2 * distance_error(block, points, categories) + 10.0**-DISTANCE_DIGITS
        bound = np.partition(d2, k - 1, axis=1)[:, k - 1] + slack
        rows, columns = np.nonzero(d2 <= bound[:, None])
        exact = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            some = slice(at, at + PAIRS_AT_ONCE)
            exact[some] = paired_squares(block[rows[some]], points[columns[some]], categories)
        ties = np.round(exact, DISTANCE_DIGITS)
        order = np.lexsort((columns, ties, rows))
        firsts = np.searchsorted(rows, np.arange(len(block)))
        best = order[firsts[:, None] + np.arange(k)]
        index[start : start + step] = columns[best]
        rounded[start : start + step] = ties[best]
        distance[start : start + step] = np.sqrt(exact[best])
    return index, rounded, distance


def pivot_distances(rows: np.ndarray, pivots: np.ndarray, categories: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distances of every row to every pivot, and for each row a bound of their error."""
    if rows.shape[1] <= DIRECT_WIDTH:
        d2 = np.zeros((len(rows), len(pivots)))
        for j in range(rows.shape[1]):
            left, right = rows[:, j, None], pivots[None, :, j]
            d2 += (left - right) ** 2 if j >= categories else (left != right) * ((left >= 0).astype(float) + (right >= 0))
        d = np.sqrt(d2)
        return d, 1e-12 * d.max(axis=1, initial=0.0)
    d2 = squared_distances(rows, pivots, categories)
    return np.sqrt(d2), np.sqrt(distance_error(rows, pivots, categories)) + 1e-12 * np.sqrt(d2.max(axis=1, initial=0.0))


def may_hold(bounds: np.ndarray, rounded_kth: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Whether a block at least ``bounds`` away can hold one of the k nearest or a tie with the k-th."""
    reach = np.sqrt(rounded_kth + 2 * 10.0**-DISTANCE_DIGITS) * (1 + 1e-12) + slack
    return bounds <= reach[:, None]


@dataclass
class Best:
    """The k nearest found so far per query: places, rounded squared distances and distances; places order ties."""

    place: np.ndarray
    rounded: np.ndarray
    distance: np.ndarray

    @classmethod
    def none(cls, n: int, k: int) -> Best:
        return cls(np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.inf), np.full((n, k), np.inf))

    def offer(self, rows: np.ndarray, place: np.ndarray, rounded: np.ndarray, distance: np.ndarray) -> None:
        k = self.place.shape[1]
        places = np.concatenate((self.place[rows], place), axis=1)
        ties = np.concatenate((self.rounded[rows], rounded), axis=1)
        order = np.lexsort((places, ties), axis=1)[:, :k]
        self.place[rows] = np.take_along_axis(places, order, axis=1)
        self.rounded[rows] = np.take_along_axis(ties, order, axis=1)
        self.distance[rows] = np.take_along_axis(np.concatenate((self.distance[rows], distance), axis=1), order, axis=1)


@dataclass
class Cells:
    """Points (in key order) in blocks: the pivot of each, its radii, and the places of its points, rising."""

    points: np.ndarray
    categories: int
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: list[np.ndarray]
    pairs: int = field(default=0, compare=False)

    @classmethod
    def of(cls, points: np.ndarray, categories: int = 0, ring_rows: int = RING_ROWS) -> Cells:
        n = len(points)
        chosen = np.random.default_rng(0).permutation(n)[: max(1, int(np.sqrt(n) / 2))]
        pivots = np.unique(points[chosen], axis=0)
        cell, radius = np.empty(n, np.int64), np.empty(n)
        step = max(1, BLOCK_CELLS // max(1, len(pivots)))
        for at in range(0, n, step):
            d, _ = pivot_distances(points[at : at + step], pivots, categories)
            cell[at : at + step] = d.argmin(axis=1)
            radius[at : at + step] = d.min(axis=1)
        order = np.lexsort((radius, cell))
        starts = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
        blocks, pivot, low, high = [], [], [], []
        for c, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            for at in range(a, b, ring_rows):
                places = order[at : min(b, at + ring_rows)]
                blocks.append(np.sort(places))
                pivot.append(c)
                low.append(radius[places[0]])
                high.append(radius[places[-1]])
        return cls(points, categories, pivots, np.array(pivot, np.int64), np.array(low), np.array(high), blocks)

    def nearest(self, queries: np.ndarray, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like :func:`nearest`, looking only at blocks that can hold one of the k nearest.

        ``within`` has a rounded squared distance per query beyond which nothing is wanted; places not found are then
        the largest number, at distance infinity.
        """
        k = k if within is not None else min(k, len(self.points))
        best = Best.none(len(queries), k)
        step = max(1, BLOCK_CELLS // max(1, len(self.blocks)))
        for at in range(0, len(queries) if k and self.blocks else 0, step):
            rows = np.arange(at, min(len(queries), at + step))
            self._search(queries, rows, best, within)
        return best.place, best.rounded, best.distance

    def _search(self, queries: np.ndarray, rows: np.ndarray, best: Best, within: np.ndarray | None) -> None:
        d, error = pivot_distances(queries[rows], self.pivots, self.categories)
        d = d[:, self.pivot]
        bounds = np.maximum(np.maximum(d - self.high, self.low - d), 0.0)
        slack = 2 * error + 1e-12 * self.high.max(initial=0.0)
        left = np.ones(bounds.shape, bool)

        def visit(some: np.ndarray, block: np.ndarray) -> None:
            order = np.argsort(block, kind="stable")
            found, starts = np.unique(block[order], return_index=True)
            for b, mine in zip(found, np.split(order, starts[1:])):
                places = self.blocks[b]
                self.pairs += len(mine) * len(places)
                who = rows[some[mine]]
                index, rounded, distance = nearest(queries[who], self.points[places], best.place.shape[1], self.categories)
                best.offer(who, places[index], rounded, distance)
            left[some, block] = False

        short = np.arange(len(rows))
        while len(short):  # the best blocks first, until every query has k points or no block is left
            score = np.where(left[short], bounds[short] + 1e-3 * d[short], np.inf)
            block = score.argmin(axis=1)
            open_ = np.isfinite(score[np.arange(len(short)), block])
            if within is not None:
                open_ &= bounds[short, block] <= np.sqrt(within[rows[short]] + 2 * 10.0**-DISTANCE_DIGITS) * (1 + 1e-12) + slack[short]
            short, block = short[open_], block[open_]
            visit(short, block)
            short = short[~np.isfinite(best.rounded[rows[short], -1])]
        reach = best.rounded[rows, -1] if within is None else np.minimum(best.rounded[rows, -1], within[rows])
        needed = left & may_hold(bounds, reach, slack)
        dense = needed.mean(axis=1) > DENSE
        if dense.any():  # little is ruled out: one pass over all points is cheaper than block by block
            who = rows[dense]
            self.pairs += len(who) * len(self.points)
            index, rounded, distance = nearest(queries[who], self.points, best.place.shape[1], self.categories)
            found = index.shape[1]
            best.place[who, :found], best.rounded[who, :found], best.distance[who, :found] = index, rounded, distance
            needed[dense] = False
        some, block = np.nonzero(needed)
        visit(some, block)
