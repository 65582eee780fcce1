"""Joins whose plan depends on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.session import cut_lineage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 256 << 20
HOT_ROWS = 1_000_000
HOT_KEYS = 1024


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, computed: bool = False) -> DataFrame:
    """Compute a dimension once, measure it, and hint a broadcast only if it is small.

    Both rows and bytes (as text) are bounded. Beyond either bound the same rows come
    back without a hint, so the join is shuffled and adaptive execution splits its hot
    partitions. ``computed`` tables are already written and are measured as they are.
    """
    small = df if computed else cut_lineage(df)
    text = F.to_json(F.struct(*(F.col(f"`{c}`") for c in small.columns)))
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()
    return F.broadcast(small) if rows <= max_rows and size <= BROADCAST_BYTES else small


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a table that a limit holds to ``rows``, if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_by_weight(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    weight: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Join a fact table to a one-row-per-key table that knows its key counts.

    Keys heavier than ``hot_rows`` (the heaviest ``hot_keys`` of them) are
    broadcast, so their facts never meet in one task; the rest is shuffled.
    Every key left in the shuffle holds less than ``max(hot_rows, 1/hot_keys)``
    of the facts.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    hot = cut_lineage(dim.where(F.col(weight) > hot_rows).orderBy(F.desc(weight), key).limit(hot_keys))
    if hot.isEmpty():
        return fact.join(dim, key, how)
    names = F.broadcast(hot.select(key))
    by_broadcast = fact.join(F.broadcast(hot), key, "inner")
    by_shuffle = fact.join(names, key, "left_anti").join(dim.join(names, key, "left_anti"), key, how)
    return by_broadcast.unionByName(by_shuffle)
