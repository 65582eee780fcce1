"""Harmonising several canonical datasets into one table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.constants import MERGED_COLUMNS
from factorloom.functions.units import standardize_unit, standardize_unit_per_kg
from factorloom.operators import crosswalk, merge, multipliers
from factorloom.operators.outliers import flag_outliers, group_statistics
from factorloom.session import stage
from factorloom.sources.registry import WITHOUT_OUTLIER_FLAG

MULTIPLIER_DATASET = "multiplier"


@dataclass(frozen=True)
class Options:
    """``exact`` units are right for new users; ``reference`` repeats the published numbers."""

    unit_mode: str = "exact"
    region_key: str = "name"
    multiplier_dataset: str = MULTIPLIER_DATASET
    order: str = "_ord"
    quantiles: str = "exact"


def canonical_union(datasets: dict[str, DataFrame]) -> DataFrame:
    """All canonical rows with one set of types, labelled by dataset and written once."""
    labelled = {name: df.withColumn("_dataset", F.lit(name)) for name, df in datasets.items()}
    return stage(merge.coerce_types(merge.stack(labelled)), "canonical")


def flag_datasets(
    df: DataFrame, written: DataFrame, method: str = "exact", without_flag: set[str] = WITHOUT_OUTLIER_FLAG
) -> DataFrame:
    """Outlier flags per dataset; the statistics read two columns of the written table.

    Datasets in ``without_flag`` keep an empty flag.
    """
    statistics = group_statistics(written, "ef_value", ["_dataset"], method)
    flagged = flag_outliers(df, by=["_dataset"], statistics=statistics)
    hidden = F.col("_dataset").isin(sorted(without_flag)) if without_flag else F.lit(False)
    return flagged.withColumn("is_outlier", F.when(~hidden, F.col("is_outlier")))


def apply_units(df: DataFrame, mode: str) -> DataFrame:
    measure = standardize_unit("ef_value", "ef_unit", mode)
    return df.withColumns({"ef_value": measure.value, "ef_unit": measure.unit})


def harmonize(
    datasets: dict[str, DataFrame], options: Options = Options(), written: DataFrame | None = None
) -> DataFrame:
    """Canonical datasets to the merged table: ids, outliers, units, multipliers.

    No step adds or drops rows. Facts are shaped and written once; statistics,
    multipliers and the counts behind the numbers read the columns they need from there.
    The rest is one job: rows move once, to be numbered in order, and are scaled and
    flagged on the way with broadcast statistics and multipliers. ``written`` is their
    ``canonical_union``, where that is at hand.
    """
    if written is None:
        written = canonical_union(datasets)
    merged = merge.number(written, options.order)
    if "is_outlier" not in written.columns:
        merged = flag_datasets(merged, written, options.quantiles)
    merged = apply_units(merged, options.unit_mode)
    if options.multiplier_dataset in datasets:
        rows = apply_units(written, options.unit_mode).where(F.col("_dataset") == options.multiplier_dataset)
        table = multipliers.multiplier_table(rows, options.order, options.region_key)
        scaled = F.col("_dataset") != options.multiplier_dataset
        merged = multipliers.apply_regional(merged, table, where=scaled, written=written)
    return merged.select(*[c for c in MERGED_COLUMNS if c in merged.columns])


def entity_crosswalk(
    datasets: dict[str, DataFrame], options: Options = Options(), written: DataFrame | None = None
) -> DataFrame:
    """Pairs of equal entities. With their ``canonical_union`` only datasets too incomplete for it are shaped here."""
    if written is None:
        entities = crosswalk.stack_entities(datasets, options.order)
    else:
        entities = written.select("entity_id", "entity_name", F.col("_dataset").alias("source_dataset"), options.order)
        apart = {n: df for n, df in datasets.items() if not merge.has_required(df) and {"entity_id", "entity_name"} <= set(df.columns)}
        if apart:
            entities = entities.unionByName(crosswalk.stack_entities(apart, options.order))
    return crosswalk.crosswalk_pairs(entities, options.order)


def harmonize_by_key(
    datasets: dict[str, DataFrame], multiplier_dataset: str = "predefined", order: str = "_ord"
) -> DataFrame:
    """Older harmoniser: per-kilogram units, ``region_type`` multiplier keys, fixed columns."""
    scaled = {}
    table = datasets.get(multiplier_dataset)
    for name, df in datasets.items():
        measure = standardize_unit_per_kg("ef_value", "ef_unit")
        part = df.withColumns({"ef_value": measure.value, "ef_unit": measure.unit})
        if table is not None and name != multiplier_dataset:
            part = multipliers.apply_by_key(part, table, order)
        scaled[name] = part
    return merge.merge_fixed(scaled, order)
