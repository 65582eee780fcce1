"""Stacking datasets, numbering records, repairing and resolving conflicts."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.constants import (
    BASE_UNIT,
    CANONICAL_COLUMNS,
    DUPLICATE_KEYS,
    MERGED_COLUMNS,
    NUMERIC_COLUMNS,
    OUTLIER_Z_GROUPED,
    REQUIRED_COLUMNS,
    STRING_COLUMNS,
)
from factorloom.functions.numbers import is_numeric_text, number_column
from factorloom.functions.tags import empty_tags, parse_strict
from factorloom.functions.text import part_before
from factorloom.operators.ordering import keep_first, number_written
from factorloom.operators.outliers import flag_outliers
from factorloom.schema import by_length
from factorloom.session import stage

log = logging.getLogger(__name__)


def padded_id(prefix: str, number: Column | str, width: int = 8) -> Column:
    """Prefix and zero-padded number; longer numbers are kept whole."""
    text = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def has_required(df: DataFrame) -> bool:
    return set(REQUIRED_COLUMNS) <= set(df.columns)


def stack(datasets: dict[str, DataFrame]) -> DataFrame:
    """Union by name of the datasets that have every required column."""
    merged = None
    for name, df in datasets.items():
        if not has_required(df):
            missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
            log.warning("dataset %s skipped, missing columns: %s", name, ", ".join(missing))
            continue
        merged = df if merged is None else merged.unionByName(df, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no dataset has the required columns")
    return merged


def coerce_types(df: DataFrame) -> DataFrame:
    """Text columns to text (null stays null), numbers to double, tags to arrays."""
    typed = {}
    for field in df.schema.fields:
        if field.name in STRING_COLUMNS:
            typed[field.name] = F.col(field.name).cast("string")
        elif field.name in NUMERIC_COLUMNS:
            typed[field.name] = number_column(df, field.name)
        elif field.name == "tags":
            is_text = isinstance(field.dataType, T.StringType)
            typed["tags"] = parse_strict("tags") if is_text else F.coalesce("tags", empty_tags())
    return df.withColumns(typed)


def number(written: DataFrame, order: str = "_ord") -> DataFrame:
    """Ids ``EF00000001`` onward in input order, for a written table."""
    return number_written(written, [order], "_n", start=1).withColumn("id", padded_id("EF", "_n")).drop("_n")


def merge(datasets: dict[str, DataFrame], order: str = "_ord") -> DataFrame:
    """One typed table of all complete datasets, with ids."""
    numbered = number(stage(coerce_types(stack(datasets)), "stacked"), order).drop(order)
    known = [c for c in MERGED_COLUMNS if c in numbered.columns]
    return numbered.select(*known, *[c for c in numbered.columns if c not in known])


def merge_fixed(datasets: dict[str, DataFrame], order: str = "_ord") -> DataFrame:
    """Older form: ten fixed columns, absent ones filled, ids ``EF_00000000`` onward."""
    merged = None
    for df in datasets.values():
        absent = {c: F.lit(None).cast("string") for c in CANONICAL_COLUMNS if c not in df.columns}
        if "tags" in absent:
            absent["tags"] = empty_tags()
        for c in NUMERIC_COLUMNS:
            if c in absent:
                absent[c] = F.lit(None).cast("double")
        part = df.withColumns(absent).select(*CANONICAL_COLUMNS, order)
        merged = part if merged is None else merged.unionByName(part)
    if merged is None:
        raise ValueError("no dataset to merge")
    return (
        number_written(stage(merged, "stacked"), [order], "_n")
        .withColumn("harmonized_id", padded_id("EF_", "_n"))
        .select(*CANONICAL_COLUMNS, "harmonized_id")
    )


def repair(df: DataFrame, order: str = "id", method: str = "exact") -> DataFrame:
    """Second pass over a merged table.

    Numeric unit text becomes the base unit, repeats on the five key columns are
    dropped (first kept), ``US`` becomes ``USA``, the entity type is cut at the
    first `` - `` and lower-cased, and outliers inside each entity type are
    added to the flags already set.
    """
    fixed = stage(
        keep_first(
            df.withColumn("ef_unit", F.when(is_numeric_text("ef_unit"), F.lit(BASE_UNIT)).otherwise(F.col("ef_unit"))),
            DUPLICATE_KEYS,
            [by_length(order) if dict(df.dtypes)[order] == "string" else F.col(order)],
        )
        .withColumn("region", F.when(F.col("region") == "US", F.lit("USA")).otherwise(F.col("region")))
        .withColumn("entity_type", F.lower(part_before("entity_type", " - "))),
        "repaired",
    )
    return flag_outliers(fixed, by=["entity_type"], z=OUTLIER_Z_GROUPED, keep_true=True, method=method)


def resolve_conflicts(
    df: DataFrame,
    keys: list[str],
    value: str = "ef_value",
    confidence: str = "confidence",
    timestamp: str = "timestamp",
    digits: int = 2,
) -> DataFrame:
    """One value per key: highest confidence, then newest, then the average.

    Confidences equal after rounding to ``digits`` count as similar. Rows are
    summed per (key, confidence, date) before any ranking.
    """
    level = F.round(F.col(confidence), digits).alias("confidence")
    summed = (
        df.dropna(subset=[value])
        .groupBy(*keys, level, F.col(timestamp).alias("timestamp"))
        .agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("merged_rows"))
    )
    best = keep_first(summed, keys, [F.desc_nulls_last("confidence"), F.desc_nulls_last("timestamp")])
    return best.select(
        *keys, (F.col("_sum") / F.col("merged_rows")).alias(value), "confidence", "timestamp", "merged_rows"
    )
