"""Vector rows packed into blocks, and a query set held against all rows block by block.

Rows travel as blocks: one row of ids, labels and a matrix. Query blocks and base
blocks are dealt to cells of a grid, and a task streams the base blocks of a cell past
its query blocks. A task holds the query blocks of one cell, one base block and the best rows so
far; only those leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import ROW, tagged
from factorloom.session import stage

#: Rows of a base block.
BASE_ROWS = 4096
#: Query rows of a cell.
QUERY_ROWS = 16_384
#: Rows that are packed at once where vectors are long: this many components at most.
BLOCK_COMPONENTS = 1 << 20

_BLOCK = "dim int, keys array<long>, ids array<long>, labels array<long>, limits array<array<long>>, matrix binary"


@dataclass
class Block:
    """Rows of one dimension: row keys (query blocks only), ids, labels, limits and vectors."""

    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    limits: list
    vectors: np.ndarray


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components only, at least one of them."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col("vec_id").isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False)))


def _element(df: DataFrame) -> str:
    kind = df.schema["embedding"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def _packed(df: DataFrame, most: int) -> DataFrame:
    """Blocks of up to ``most`` rows; a partition keeps its own rows, each dimension in its own blocks."""
    element = _element(df)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple]] = {}

        def block(dim: int) -> pd.DataFrame:
            keys, ids, labels, limits, vectors = zip(*held.pop(dim))
            matrix = np.array(vectors, element).tobytes()
            return pd.DataFrame(
                {"dim": [dim], "keys": [keys], "ids": [ids], "labels": [labels], "limits": [limits], "matrix": [matrix]}
            )

        for batch in batches:
            for row in batch[["key", "vec_id", "label", "limits", "embedding"]].itertuples(index=False, name=None):
                dim = len(row[4])
                own = held.setdefault(dim, [])
                own.append(row)
                if len(own) >= most or len(own) * dim >= BLOCK_COMPONENTS:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return df.mapInPandas(pack, _BLOCK)


def _read(row) -> Block:
    element = "<f4" if len(row.matrix) == 4 * row.dim * len(row.ids) else "<f8"
    vectors = np.frombuffer(row.matrix, element).reshape(-1, row.dim).astype(np.float64)
    return Block(np.array(row.keys, np.int64), np.array(row.ids, np.int64), np.array(row.labels, np.int64), list(row.limits), vectors)


#: Takes the query blocks of a cell; the returned object takes base blocks one by one and gives its rows in the end.
Cell = Callable[[list[Block]], "CellState"]


class CellState:
    def add(self, base: Block) -> None:
        raise NotImplementedError

    def rows(self) -> Iterator[pd.DataFrame]:
        raise NotImplementedError


def tagged_queries(df: DataFrame) -> DataFrame:
    """Query rows (``vec_id, label, limits, embedding``) written once, with a ``key`` that stays the same."""
    return tagged(df, "vector-queries").withColumnRenamed(ROW, "key")


def against_all(queries: DataFrame, base: DataFrame, cell: Cell, schema: str) -> DataFrame:
    """Rows that ``cell`` gives for the tagged ``queries`` held against all rows of ``base``.

    ``queries`` has ``key, vec_id, label, limits, embedding``, ``base`` has ``vec_id, label,
    embedding``. Query rows are dealt to ``groups`` of about ``QUERY_ROWS``; few groups are
    repeated over several shares of the base, so that all tasks have work. Base rows are
    moved once for each group, queries once for each share, and nothing is broadcast.
    """
    spark = base.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    shares = max(1, -(-2 * partitions // groups))
    # rows are dealt out evenly, whatever their ids, and a partition is a group
    query_blocks = stage(
        _packed(queries.repartition(groups), QUERY_ROWS).withColumn("group", F.spark_partition_id().cast("long")), "vector-blocks"
    )
    base_rows = base.select(
        F.lit(0).cast("long").alias("key"), "vec_id", "label", F.lit(None).cast("array<long>").alias("limits"), "embedding"
    )
    base_blocks = _packed(base_rows, BASE_ROWS).withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares)))

    def every(n: int, name: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)

    columns = ["dim", "keys", "ids", "labels", "limits", "matrix"]
    rows = (
        query_blocks.select(F.lit(0).alias("kind"), "group", every(shares, "share"), *columns)
        .unionByName(base_blocks.select(F.lit(1).alias("kind"), every(groups, "group"), "share", *columns))
        .withColumn("cell", F.col("group") * F.lit(shares) + F.col("share"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, blocks, state = None, [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.cell != at:
                    if state is not None:
                        yield from state.rows()
                    at, blocks, state = row.cell, [], None
                if row.kind == 0:
                    blocks.append(_read(row))
                elif blocks:
                    state = state or cell(blocks)
                    state.add(_read(row))
        if state is not None:
            yield from state.rows()

    dealt_out = rows.repartition(partitions, "cell").sortWithinPartitions("cell", "kind")
    return dealt_out.mapInPandas(run, schema)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first rows: higher scores first, ties by smaller id."""
    if scores.size > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, scores.size - k)[scores.size - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
