"""Linking the same entity across datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.constants import CROSSWALK_CONFIDENCE
from factorloom.functions.text import simplify_name
from factorloom.operators.ordering import dense_index
from factorloom.operators.sizing import HOT_ROWS, join_by_weight
from factorloom.session import stage


def stack_entities(datasets: dict[str, DataFrame], order: str = "_ord") -> DataFrame:
    """Entity columns of every dataset that has them, labelled by dataset name."""
    stacked = None
    for name, df in datasets.items():
        if {"entity_id", "entity_name"} <= set(df.columns):
            part = df.select("entity_id", "entity_name", F.lit(name).alias("source_dataset"), order)
            stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no dataset has entity_id and entity_name")
    return stacked


def crosswalk_pairs(entities: DataFrame, order: str = "_ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pair every later row of a simplified name with the name's first row.

    The first row per name is a partial aggregate, not a window over the whole
    group, and names too heavy for one task are joined by broadcast. Rows
    without a name are dropped; repeats inside one dataset count. The narrow
    name table is staged, so the datasets behind it are shaped once.
    """
    named = stage(entities.withColumn("_name", simplify_name("entity_name")).where("_name is not null"), "names")
    primary = (
        named.groupBy("_name")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min(F.struct(order, "entity_id", "entity_name", "source_dataset")).alias("_first"),
        )
        .where("_rows > 1")
    )
    joined = join_by_weight(named, primary, "_name", "_rows", hot_rows=hot_rows)
    return joined.where(F.col(order) > F.col(f"_first.{order}")).select(
        F.col("_first.entity_id").alias("primary_id"),
        F.col("_first.entity_name").alias("primary_name"),
        F.col("_first.source_dataset").alias("primary_source"),
        F.col("entity_id").alias("secondary_id"),
        F.col("entity_name").alias("secondary_name"),
        F.col("source_dataset").alias("secondary_source"),
        F.lit(CROSSWALK_CONFIDENCE).alias("match_confidence"),
    )


def canonical_entities(entities: DataFrame, order: str = "_ord", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Older form: every row with ``ENT_nnnnnn``, the 0-based place of its name's first row.

    A missing name is a name of its own and matches other missing names.
    """
    keyed = dense_index(entities, [order], "_place").withColumn(
        "_name", F.coalesce(F.concat(F.lit("="), F.col("entity_name")), F.lit(""))
    )
    first = keyed.groupBy("_name").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    joined = join_by_weight(keyed, first, "_name", "_rows", hot_rows=hot_rows)
    number = F.col("_first").cast("string")
    padded = F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0"))
    return joined.select(
        "entity_id", "entity_name", "source_dataset", F.concat(F.lit("ENT_"), padded).alias("canonical_id")
    )
