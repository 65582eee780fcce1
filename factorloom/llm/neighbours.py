"""Nearest neighbours by largest inner product, by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` random lines, each kept as a sorted array.
A query opens a window around its own projection in each array; a row that is in the
windows of at least ``threshold`` lines collides and is verified on the original
vectors. The windows grow (virtual rehashing: the same arrays serve every radius, and
only what a window newly covers is counted) until ``k`` rows are verified and the
radius has reached the distance of the ``k``-th of them.

For a row at distance ``r`` from the query, the projections differ by a normal value
of deviation ``r``. At radius ``r`` a window reaches ``WIDTH * r`` to both sides, so each
line holds the row with the same known chance, and ``threshold`` is the number of lines
that a row reaches with a chance of ``FOUND`` at least. A row nearer than the radius is
found with a greater chance. That bounds the expected recall from below by ``FOUND``
for every query, whatever the data. No number of candidates is limited.

Largest inner product becomes smallest distance by one more component, the square root
of what a row's squared length lacks to the largest one (0 for queries).

Defined cases: rows with a null id or a vector that is null, empty, zero or holds a null
or non-finite component take no part; vectors of different length are no neighbours; a row is no
neighbour of a row with its own id; rows with equal ids are rows of their own, as
queries, too; with fewer than ``k`` candidates all come back; an empty table gives no
row; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.vectors import Block, CellState, against_all, first, tagged_queries, usable

NEAREST = 20
PROJECTIONS = 64
#: A window reaches so many radii to both sides.
WIDTH = 1.25
#: Least chance that a row within the radius collides often enough.
FOUND = 0.97
#: A radius grows by this factor.
GROWTH = 1.5
#: The first windows of a query hold this part of a block's rows on a line: fewer rarely reach the threshold.
FIRST = 1 / 3
SEED = 20

#: Queries whose windows grow together.
_AT_ONCE = 256

_FOUND_ROWS = "key long, scores array<double>, ids array<long>"


def threshold(lines: int = PROJECTIONS, width: float = WIDTH, found: float = FOUND) -> int:
    """Largest number of lines that a row at the radius reaches with a chance of ``found`` at least."""
    p = math.erf(width / math.sqrt(2))
    chance, least = 0.0, lines
    while least > 1:
        chance += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
        if chance >= found:
            break
        least -= 1
    return least


@cache
def _lines(dim: int) -> np.ndarray:
    """Directions of the lines, one more component for the missing length."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim + 1, PROJECTIONS))


def products(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component, so that they do not depend on the block."""
    return np.add.accumulate(rows.T * query[:, None], axis=0)[-1]


class _Arrays:
    """Sorted projections of a base block."""

    def __init__(self, base: Block, longest: float):
        squared = np.einsum("ij,ij->i", base.vectors, base.vectors)
        lacking = np.sqrt(np.maximum(0.0, longest - squared))
        projected = np.column_stack((base.vectors, lacking)) @ _lines(base.vectors.shape[1])
        self.base = base
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def windows(self, centres: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each query's window in each array."""
        lo = np.empty(centres.shape, np.int64)
        hi = np.empty(centres.shape, np.int64)
        for line in range(PROJECTIONS):
            lo[:, line] = np.searchsorted(self.sorted[line], centres[:, line] - half, "left")
            hi[:, line] = np.searchsorted(self.sorted[line], centres[:, line] + half, "right")
        return lo, hi

    def count(self, lo: np.ndarray, left: np.ndarray, right: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For every row, the lines whose array has it from ``lo`` to ``left`` or from ``right`` to ``hi``."""
        parts = []
        for order, a, b, c, d in zip(self.order, lo.tolist(), left.tolist(), right.tolist(), hi.tolist()):
            if a < b:
                parts.append(order[a:b])
            if c < d:
                parts.append(order[c:d])
        if not parts:
            return np.zeros(self.base.ids.size, np.int16)
        return np.bincount(np.concatenate(parts), minlength=self.base.ids.size).astype(np.int16)

    def start(self, centres: np.ndarray) -> np.ndarray:
        """A radius at which windows have about ``FIRST`` of the rows, by the places around the centre."""
        rows = self.base.ids.size
        aside = max(1, int(rows * FIRST / 2))
        reach = np.zeros(centres.shape)
        for line in range(PROJECTIONS):
            at = np.searchsorted(self.sorted[line], centres[:, line])
            upper = self.sorted[line][np.minimum(at + aside, rows - 1)]
            lower = self.sorted[line][np.maximum(at - aside, 0)]
            reach[:, line] = np.maximum(np.abs(upper - centres[:, line]), np.abs(centres[:, line] - lower))
        return np.median(reach, axis=1) / WIDTH + 1e-12


class _Search(CellState):
    def __init__(self, blocks: list[Block], k: int, longest: float):
        self.k, self.longest = k, longest
        self.blocks = blocks
        self.centres = [b.vectors @ _lines(b.vectors.shape[1])[:-1] for b in blocks]
        self.squared = [np.einsum("ij,ij->i", b.vectors, b.vectors) for b in blocks]
        self.scores = [[np.zeros(0) for _ in b.keys] for b in blocks]
        self.ids = [[np.zeros(0, np.int64) for _ in b.keys] for b in blocks]

    def add(self, base: Block) -> None:
        arrays = None
        for n, block in enumerate(self.blocks):
            if block.vectors.shape[1] != base.vectors.shape[1]:
                continue
            arrays = arrays or _Arrays(base, self.longest)
            for at in range(0, block.keys.size, _AT_ONCE):
                self._grow(n, np.arange(at, min(at + _AT_ONCE, block.keys.size)), arrays)

    def _reach(self, n: int, row: int) -> float:
        """Distance of the ``k``-th verified row; rows farther away change nothing."""
        scores = self.scores[n][row]
        if scores.size < self.k:
            return math.inf
        return math.sqrt(max(0.0, self.longest + self.squared[n][row] - 2 * scores[-1]))

    def _grow(self, n: int, rows: np.ndarray, arrays: _Arrays) -> None:
        """Open the windows of some queries until no nearer row is to be expected in the block."""
        size, least = arrays.base.ids.size, threshold()
        centres = self.centres[n][rows]
        goal = np.array([self._reach(n, r) for r in rows])
        radius = np.where(np.isfinite(goal), goal, arrays.start(centres))
        counts = np.zeros((rows.size, size), np.int16)
        # empty windows at the centres
        left = np.column_stack([np.searchsorted(a, centres[:, line]) for line, a in enumerate(arrays.sorted)])
        right = left.copy()
        open_rows = np.arange(rows.size)
        while open_rows.size:
            lo, hi = arrays.windows(centres[open_rows], WIDTH * radius[open_rows])
            still = []
            for q, own_lo, own_hi in zip(open_rows, lo, hi):
                row, before = rows[q], counts[q] >= least
                inside = int((own_hi - own_lo).sum())
                if inside - int((right[q] - left[q]).sum()) <= size * PROJECTIONS - inside:
                    counts[q] += arrays.count(own_lo, left[q], right[q], own_hi)
                else:  # fewer entries are outside the windows than newly inside
                    counts[q] = PROJECTIONS - arrays.count(np.zeros_like(own_lo), own_lo, own_hi, np.full_like(own_hi, size))
                left[q], right[q] = own_lo, own_hi
                self._verify(n, row, arrays.base, np.flatnonzero((counts[q] >= least) & ~before))
                reach = self._reach(n, row)
                everything = inside == size * PROJECTIONS
                if radius[q] < reach and not everything:
                    radius[q] = min(radius[q] * GROWTH, reach) if math.isfinite(reach) else radius[q] * GROWTH
                    still.append(q)
            open_rows = np.array(still, np.int64)

    def _verify(self, n: int, row: int, base: Block, places: np.ndarray) -> None:
        block = self.blocks[n]
        places = places[base.ids[places] != block.ids[row]]
        if self.scores[n][row].size == self.k or places.size > self.k:
            # a fast product first: what is behind by more than its rounding cannot be among the best
            near = base.vectors[places] @ block.vectors[row]
            worst = self.scores[n][row][-1] if self.scores[n][row].size == self.k else np.partition(near, -self.k)[-self.k]
            slack = 1e-15 * base.vectors.shape[1] * math.sqrt(self.longest * self.squared[n][row])
            places = places[near >= worst - slack]
        if places.size:
            scores = np.concatenate((self.scores[n][row], products(block.vectors[row], base.vectors[places])))
            ids = np.concatenate((self.ids[n][row], base.ids[places]))
            keep = first(scores, ids, self.k)
            self.scores[n][row], self.ids[n][row] = scores[keep], ids[keep]

    def rows(self) -> Iterator[pd.DataFrame]:
        for n, block in enumerate(self.blocks):
            yield pd.DataFrame({"key": block.keys, "scores": self.scores[n], "ids": self.ids[n]})


def nearest(rows: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query among all rows.

    ``rows`` has ``vec_id, embedding``; ``is_query`` tells the queries.
    """
    base = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("label"), "embedding"))
    base = base.where(F.exists("embedding", lambda x: x != 0))
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = base.agg(F.max(squared)).head()[0] or 0.0
    queries = tagged_queries(base.where(is_query).withColumn("limits", F.lit(None).cast("array<long>")))
    found = against_all(queries, base, lambda blocks: _Search(blocks, k, longest), _FOUND_ROWS)
    pairs = found.select("key", F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("vec_id"))))
    ranked = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k)
    names = queries.select("key", F.col("vec_id").alias("query_id"))
    return best.join(names, "key").select("query_id", "rank", "vec_id", "score")
