"""Checksum of a table of any size as a tree of hashes, and the ranges in which two versions differ.

A leaf stands for a fixed range of an integer key. Its hash is made of the number of its
rows and sums over the rows' MD5 sums, so tasks add up their own rows before anything
is moved, no rows are gathered, and row order does not matter; neither does how many rows a
range has. The nodes above hash the ``FAN`` nodes below them, up to one root. Rows
that are added or taken away change their own range only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.session import stage

#: Nodes below a node.
FAN = 64
#: Keys in the range of a leaf.
WIDTH = 100_000


def row_hash(columns: list[str]) -> Column:
    """MD5 of a row: its values as JSON-quoted text, so that none runs into the next, a null as ``N``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.md5(F.concat_ws(",", *(F.coalesce(quoted(c), F.lit("N")) for c in columns)))


def leaves(df: DataFrame, key: str, columns: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """``level, node, rows, hash`` of the key ranges that have rows; rows with a null key are range -1, keys below 0 are refused."""
    part = lambda start: F.conv(F.substring(F.col("_md5"), start, 15), 16, 10).cast("decimal(38,0)")
    node = F.coalesce(F.floor(F.col(f"`{key}`").cast("long") / width), F.lit(-1)).cast("long")
    node = F.when(F.col(f"`{key}`") < 0, F.raise_error(F.lit("keys of a hash tree are not negative")).cast("long")).otherwise(node)
    sums = (
        df.select(node.alias("node"), row_hash(columns or df.columns).alias("_md5"))
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b"))
    )
    text = F.concat_ws("|", F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select(F.lit(0).alias("level"), "node", "rows", F.md5(text).alias("hash"))


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: a node hashes the numbers and hashes of the up to ``FAN`` nodes below."""
    entry = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("text"))
    below = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"])
    parent = F.floor(F.col("node") / FAN).cast("long")
    return nodes.groupBy((F.col("level") + 1).alias("level"), parent.alias("node")).agg(
        F.sum("rows").alias("rows"), F.md5(F.array_join(below, ",")).alias("hash")
    )


def hash_tree(df: DataFrame, key: str, columns: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """All nodes (``level, node, rows, hash``); the highest level has the root alone. An empty table has no node."""
    levels = [stage(leaves(df, key, columns, width), "hash-leaves")]
    least, most = levels[0].agg(F.min("node"), F.max("node")).head()
    while most is not None and least != most:
        levels.append(stage(_above(levels[-1]), "hash-level"))
        # floor of a negative range stays one below: it joins the first node in the end
        least, most = levels[-1].agg(F.min("node"), F.max("node")).head()
        if (least, most) == (-1, 0):
            levels.append(stage(_root(levels[-1]), "hash-level"))
            break
    return reduce(DataFrame.unionAll, levels)


def _root(nodes: DataFrame) -> DataFrame:
    """Ranges -1 (null keys) and 0 under one node."""
    return _above(nodes.withColumn("node", F.col("node") + 1)).withColumn("node", F.lit(0).cast("long"))


def root(tree: DataFrame) -> tuple[int, str] | None:
    """Rows and hash of the root."""
    found = tree.orderBy(F.desc("level")).select("rows", "hash").head()
    return None if found is None else (found["rows"], found["hash"])


def changed_ranges(before: DataFrame, after: DataFrame, width: int = WIDTH) -> DataFrame:
    """``first_key, last_key, rows_before, rows_after`` of the leaf ranges in which two trees differ.

    Two trees with equal roots are settled by one row each; otherwise leaves are
    compared, one row per range, never the rows of the tables.
    """
    if root(before) == root(after):
        before = before.limit(0)
        after = after.limit(0)
    a = before.where("level = 0").select("node", F.col("rows").alias("rows_before"), F.col("hash").alias("_a"))
    b = after.where("level = 0").select("node", F.col("rows").alias("rows_after"), F.col("hash").alias("_b"))
    differ = a.join(b, "node", "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    known = F.col("node") >= 0
    return differ.select(
        F.when(known, F.col("node") * width).alias("first_key"),
        F.when(known, (F.col("node") + 1) * width - 1).alias("last_key"),
        F.coalesce("rows_before", F.lit(0)).cast("long").alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).cast("long").alias("rows_after"),
    )
