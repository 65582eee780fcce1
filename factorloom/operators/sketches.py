"""Distinct counts that take new rows without reading old ones.

A sketch of fixed size stands for the values of a column in a group, such as a source and a
day. Sketches merge in any order and any grouping, which moves a count by less than its
error, so stored ones of many days give the count over all of them. Exact counts (:mod:`factorloom.operators.profile`) stay the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sketches of 2**14 registers: a standard error of about 0.8 %, below 2 % in more than 98 of 100 counts, 16 KB at most.
LG_K = 14


def distinct_sketches(df: DataFrame, columns: list[str], by: list[str], lg_k: int = LG_K) -> DataFrame:
    """``*by, column, sketch``: one row per group and column; nulls are no values."""
    sketches = [F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg_k).alias(f"_s{k}") for k, c in enumerate(columns)]
    found = df.groupBy(*by).agg(*sketches)
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_s{k}").alias("sketch")) for k, c in enumerate(columns)]
    return found.select(*by, F.inline(F.array(*entries)))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of fewer, wider groups."""
    return sketches.groupBy(*by, "column").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """The distinct count that each sketch stands for."""
    return sketches.withColumn("distinct_values", F.hll_sketch_estimate("sketch")).drop("sketch")


def store_sketches(df: DataFrame, path: str, columns: list[str], by: list[str], batch: str) -> None:
    """Sketches of new rows, kept as one batch; the same batch again takes the place of the one before."""
    distinct_sketches(df, columns, by).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def stored_counts(spark: SparkSession, path: str, by: list[str], where: Column | None = None) -> DataFrame:
    """Distinct counts over the stored batches that ``where`` selects, from sketches alone."""
    stored = spark.read.parquet(path)
    return estimates(merged_sketches(stored if where is None else stored.where(where), by))
