"""Global row numbers, first-seen ordinals and keep-first rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.session import stage

def dense_index(df: DataFrame, order: list[str], name: str = "_n", start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``order`` without one global window.

    One range shuffle sorts the rows across partitions, and each partition is
    written as a parquet file. A number is a row's place in its file plus the rows of
    the files before. The table is columnar, so later jobs read only what they use;
    one count per file is broadcast.
    """
    ranged = stage(df.repartitionByRange(*order).sortWithinPartitions(*order), "indexed")
    placed = ranged.select(
        "*", F.col("_metadata.row_index").alias("_offset"), _part(F.col("_metadata.file_name")).alias("_slot")
    )
    sizes = placed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per file
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(offsets), "_slot")
        .withColumn(name, F.col("_before") + F.col("_offset") + F.lit(start))
        .drop("_slot", "_offset", "_before")
    )


#: Order keys drawn for each range partition, to find the bounds between them.
SAMPLE_KEYS = 64


def number_written(written: DataFrame, order: list[str], name: str = "_n", start: int = 0) -> DataFrame:
    """Consecutive numbers of a written table in the order of ``order``, without writing it again.

    Two small jobs read the order keys alone: one draws bounds, one counts the rows
    between them. The rows are then moved once, to range partitions sorted inside, as
    part of the job that uses the result: a number is the place in the partition
    plus the rows of the ranges before. ``order`` must tell all rows apart, since nothing
    is kept of the order of equal ones. For a result that is read often, :func:`dense_index` writes it.
    """
    partitions = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = written.select(*order)
    bounds = _bounds(keys, partitions)
    slot = _bounds_below(bounds, F.struct(*order), keys.schema)
    counts = {row["slot"]: row["count"] for row in keys.select(slot.alias("slot")).groupBy("slot").count().collect()}
    before = [sum(counts.get(k, 0) for k in range(n)) + start for n in range(partitions)]
    ranged = written.repartitionById(partitions, slot).sortWithinPartitions(*order)
    # the identifier counts the rows of a partition in its lower 33 bits
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    offset = F.get(F.array(*(F.lit(n).cast("long") for n in before)), F.spark_partition_id())
    return ranged.withColumn(name, offset + row)


def _bounds(keys: DataFrame, partitions: int) -> list[Row]:
    """Keys that cut a random sample into equal parts, ascending; fewer where keys repeat or are few."""
    if partitions < 2:
        return []
    # every task keeps so many keys at most
    drawn = keys.orderBy(F.rand(0)).limit(SAMPLE_KEYS * partitions)
    found = drawn.agg(F.array_sort(F.collect_list(F.struct(*keys.columns))).alias("keys"))
    count = F.size("keys")
    cuts = F.transform(F.sequence(F.lit(1), F.lit(partitions - 1)), lambda k: F.get("keys", F.floor(k * count / partitions).cast("int")))
    return [key for key in found.select(F.array_distinct(cuts).alias("cuts")).head()[0] if key is not None]


def _bounds_below(bounds: list[Row], key: Column, schema: T.StructType) -> Column:
    """Number of bounds that are not above a key, by binary search."""
    if not bounds:
        return F.lit(0)
    rows = [F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields))) for row in bounds]
    listed = F.array(*rows)
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    # a bound behind the last one is missing, and null is no "yes"
    reached = lambda at, step: F.coalesce(F.get(listed, at + step - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))


def _part(file_name: Column) -> Column:
    """The number of the partition that wrote a file."""
    return F.regexp_extract(file_name, r"part-(\d+)", 1).cast("long")


def first_seen(df: DataFrame, value: str, order: str = "_ord") -> DataFrame:
    """Distinct non-null values with the order key of their first row."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))


def first_seen_ordinals(df: DataFrame, value: str, order: str = "_ord", start: int = 1) -> DataFrame:
    """Distinct values numbered by first appearance."""
    return dense_index(first_seen(df, value, order), ["_first"], "_n", start)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in the given order; null keys count as equal.

    Spark limits each map task to one row per key ahead of the shuffle.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def keep_distinct(df: DataFrame) -> DataFrame:
    """Drop rows equal to another row in every column."""
    return df.distinct()


def top_per_group(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group, numbered from 1."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).where(F.col(name) <= k)


def duplicate_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows in duplicate groups, groups, rows a keep-first drops."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return counts.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("removable_rows"),
    )
