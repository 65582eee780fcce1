"""Hard negatives by slot decomposition.

A positive's window of scores reaches from a share of its score up to another share.
Only its upper end decides where the window starts, so the upper ends of an anchor's
positives cut the scores into disjoint slots. One pass over all rows keeps the first
``k`` rows of every slot (a task combines them before anything is moved), and the
rows of a window are then a suffix of the slots: merged from the lowest slot upwards,
each merge keeping ``k``, one merge answers the window that starts there. The lower
end cuts the answer afterwards, since it can only take rows from its end.

Scores are inner products of whole numbers, each component being ``floor(scale * x)``.
They are exact: in doubles where the products are small enough, else in Python's
integers; a score beyond 64 bits counts as the nearest 64-bit number.

Defined cases: rows with a null id, a null label, a null or empty vector or a null or
non-finite component take no part; vectors of different length have no score; a row
never meets rows with its own id, and rows with equal ids are rows of their own
(as anchors, too); repeated rows come back each; an anchor without positives gives
nothing, and neither does a positive whose window is empty (a negative score); an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.vectors import Block, CellState, against_all, first, tagged_queries, usable
from factorloom.session import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: The window of a positive's score, in hundredths.
LOWER, UPPER = 30, 90

_EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63) + 1, (1 << 63) - 1

_FOUND = "key long, slot int, scores array<long>, ids array<long>"


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit numbers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.clip(exact, _LEAST, _MOST).astype(np.int64)
    return (a @ b.T).astype(np.int64)


class _Best:
    """First ``k`` rows of a (anchor, slot)."""

    __slots__ = ("scores", "ids")

    def __init__(self):
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        if self.scores.size == k:
            last = self.scores[-1]
            better = (scores > last) | ((scores == last) & (ids < self.ids[-1]))
            scores, ids = scores[better], ids[better]
        if scores.size:
            scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
            keep = first(scores, ids, k)
            self.scores, self.ids = scores[keep], ids[keep]


class _State(CellState):
    def __init__(self, anchors: list[Block], k: int):
        self.k = k
        self.anchors = anchors
        self.numbers = [whole_numbers(b.vectors) for b in anchors]
        self.best: dict[tuple[int, int], _Best] = {}

    def put(self, key: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.size:
            self.best.setdefault((key, slot), _Best()).add(scores, ids, self.k)

    def rows(self) -> Iterator[pd.DataFrame]:
        found = [(key, slot, b.scores, b.ids) for (key, slot), b in self.best.items()]
        yield pd.DataFrame(found, columns=["key", "slot", "scores", "ids"])


#: Anchors that are scored at once against a base block.
_AT_ONCE = 512


def _scored(state: _State, base: Block) -> Iterator[tuple[Block, int, np.ndarray]]:
    """Anchor block, row and its scores against the base block."""
    numbers = whole_numbers(base.vectors)
    for block, own in zip(state.anchors, state.numbers):
        if own.shape[1] != numbers.shape[1]:
            continue
        for at in range(0, own.shape[0], _AT_ONCE):
            for row, line in enumerate(scores(own[at : at + _AT_ONCE], numbers), at):
                yield block, row, line


class _Positives(_State):
    """First rows of the anchor's label."""

    def add(self, base: Block) -> None:
        for block, row, line in _scored(self, base):
            own = np.flatnonzero((base.labels == block.labels[row]) & (base.ids != block.ids[row]))
            self.put(int(block.keys[row]), 0, line[own], base.ids[own])


class _Negatives(_State):
    """First rows of other labels in every slot; ``limits`` has the upper ends, descending, and behind them the least lower end."""

    def add(self, base: Block) -> None:
        for block, row, line in _scored(self, base):
            *tops, least = block.limits[row]
            other = (base.labels != block.labels[row]) & (base.ids != block.ids[row])
            own = np.flatnonzero(other & (line <= tops[0]) & (line >= least))
            if not own.size:
                continue
            # slot s has the scores from its upper end down to the next one
            slot = np.searchsorted(-np.array(tops, np.int64), -line[own], side="right") - 1
            for s in np.unique(slot):
                in_slot = own[slot == s]
                self.put(int(block.keys[row]), int(s), line[in_slot], base.ids[in_slot])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``key, slot, score, id`` of the first ``k`` rows of every (key, slot)."""
    rows = found.select("key", "slot", F.inline(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id"))))
    ranked = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k).drop("_rank")


def upper_end(score: Column) -> Column:
    """Largest score within ``UPPER`` hundredths of ``score``."""
    return F.floor(score.cast("decimal(20,0)") * UPPER / 100).cast("long")


def lower_end(score: Column) -> Column:
    """Smallest score of at least ``LOWER`` hundredths of ``score``."""
    return F.ceil(score.cast("decimal(20,0)") * LOWER / 100).cast("long")


def positives(anchors: DataFrame, base: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``key, score, id``: the first ``k`` other rows of each anchor's label."""
    found = against_all(anchors, base, lambda blocks: _Positives(blocks, k), _FOUND)
    return _merged(found, k).drop("slot")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, embedding``; ``is_anchor`` tells its anchors.
    """
    named = rows.where("label is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    )
    base = usable(named)
    anchors = tagged_queries(base.where(is_anchor).withColumn("limits", F.lit(None).cast("array<long>")))
    chosen = (
        positives(anchors, base, n_positives)
        .withColumns({"top": upper_end(F.col("score")), "least": lower_end(F.col("score"))})
        .where("least <= top")
    )
    # at most n_positives entries an anchor
    windows = chosen.groupBy("key").agg(
        F.reverse(F.array_sort(F.collect_set("top"))).alias("tops"),
        F.min("least").alias("floor"),
        F.collect_list(F.struct("id", "score", "top", "least")).alias("chosen"),
    )
    windows = anchors.drop("limits").join(windows, "key")
    limited = stage(windows.withColumn("limits", F.concat("tops", F.array("floor"))), "anchor-windows")
    found = against_all(
        limited.select("key", "vec_id", "label", "limits", "embedding"), base, lambda blocks: _Negatives(blocks, n_negatives), _FOUND
    )
    entry = F.struct("slot", (-F.col("score")).alias("minus"), "id")
    # at most n_positives * n_negatives entries an anchor
    slots = _merged(found, n_negatives).groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    answers = limited.select("key", F.col("vec_id").alias("anchor_id"), "tops", F.explode("chosen").alias("p")).join(
        _suffixes(slots, n_negatives, n_positives), "key"
    )
    start = F.array_position("tops", F.col("p.top")).cast("int") - 1
    inside = F.filter(F.get("suffixes", start), lambda x: -x["minus"] >= F.col("p.least"))
    placed = answers.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(inside).alias("place", "n")
    )
    return placed.select(
        "anchor_id",
        "positive_id",
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"),
        "positive_score",
        (-F.col("n.minus")).alias("negative_score"),
    )


def _suffixes(slots: DataFrame, k: int, most: int) -> DataFrame:
    """``key, suffixes``: for every slot, the first ``k`` entries of it and all lower slots, merged from the lowest one."""
    own = lambda s: F.filter("entries", lambda x: x["slot"] == s)
    # the slots are disjoint and descend, so a merge puts one list behind the other
    merge = lambda held, s: F.concat(F.array(F.slice(F.concat(own(s), F.get(held, F.lit(0))), 1, k)), held)
    empty = F.array(F.filter("entries", lambda x: F.lit(False)))
    return slots.select("key", F.aggregate(F.sequence(F.lit(most - 1), F.lit(0)), empty, merge).alias("suffixes"))
