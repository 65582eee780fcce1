"""Graph questions as DataFrame functions.

Each pattern filters and groups facts on their own columns first and joins the
node tables to the few rows that are left. Sort orders place missing values
as the graph query language does: first when descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.bands import value_band
from factorloom.functions.text import hash_key
from factorloom.plans.graph import FactorGraph, existing


def _region_names(g: FactorGraph) -> DataFrame:
    return g.regions.select(F.col("region_code").alias("region"), F.col("name").alias("region_name"))


def node_counts(g: FactorGraph) -> DataFrame:
    labels = [
        ("EmissionFactor", g.facts),
        ("Region", g.regions),
        ("EntityType", g.types),
        ("Source", g.sources),
    ]
    counts = None
    for label, df in labels:
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(label).alias("label"), "rows")
        counts = part if counts is None else counts.unionByName(part)
    return counts.orderBy(F.desc("rows"), "label")


def edge_counts(g: FactorGraph) -> DataFrame:
    """Relationship counts from one scan; an edge exists when its end does."""
    ends = [("APPLIES_TO_REGION", "region"), ("HAS_ENTITY_TYPE", "entity_type"), ("SOURCED_FROM", "source_dataset")]
    counted = g.facts.agg(*[F.count(c).alias(name) for name, c in ends])
    facts = counted.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("relation"), F.col(n).alias("rows")) for n, _ in ends]))
    )
    known = g.regions.select("region_code")
    parents = (
        g.hierarchy.join(known.withColumnRenamed("region_code", "child_region_code"), "child_region_code", "left_semi")
        .join(known.withColumnRenamed("region_code", "parent_region_code"), "parent_region_code", "left_semi")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("PART_OF").alias("relation"), "rows")
    )
    return facts.unionByName(parents)


def compare_regions(g: FactorGraph, entity_type: str, regions: list[str]) -> DataFrame:
    """Average and count per region for one entity type."""
    means = (
        g.facts.where((F.col("entity_type") == entity_type) & F.col("region").isin(regions))
        .groupBy("region")
        .agg(F.avg("ef_value").alias("avg_value"), F.count(F.lit(1)).alias("rows"))
    )
    return means.join(_region_names(g), "region").select("region_name", "avg_value", "rows").orderBy(
        F.desc_nulls_first("avg_value"), "region_name"
    )


def region_against(g: FactorGraph, region: str, other: str, limit: int | None = None) -> DataFrame:
    """Averages of two regions per entity type, most different ratio first.

    Pairing all facts of both regions would make ``n1 * n2`` rows; each side is
    grouped first instead. Pairing repeats every value equally often, so the
    averages are unchanged, and the pair count is the product (also given: ``n1``).
    """

    def side(code: str, value: str, n: str) -> DataFrame:
        rows = g.facts.where((F.col("region") == code) & existing("entity_type"))
        return rows.groupBy("entity_type").agg(F.avg("ef_value").alias(value), F.count(F.lit(1)).alias(n))

    both = side(region, "region_avg", "n1").join(side(other, "other_avg", "n2"), "entity_type")
    compared = both.select(
        "entity_type",
        "region_avg",
        "other_avg",
        F.try_divide("region_avg", "other_avg").alias("ratio"),
        (F.col("n1") * F.col("n2")).alias("pairs"),
        "n1",
    ).orderBy(F.desc_nulls_first(F.abs(F.col("ratio") - 1)), "entity_type")
    return compared.limit(limit) if limit else compared


def type_statistics(g: FactorGraph) -> DataFrame:
    return (
        g.facts.where(~F.col("is_outlier") & existing("entity_type"))
        .groupBy("entity_type")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("ef_value").alias("avg_value"),
            F.min("ef_value").alias("min_value"),
            F.max("ef_value").alias("max_value"),
        )
        .orderBy(F.desc("rows"), "entity_type")
    )


def value_bands(g: FactorGraph) -> DataFrame:
    return (
        g.facts.where(existing("entity_type"))
        .groupBy("entity_type", value_band("ef_value").alias("value_range"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("entity_type", "value_range")
    )


def source_confidence(g: FactorGraph) -> DataFrame:
    return (
        g.facts.where(existing("source_dataset"))
        .groupBy("source_dataset")
        .agg(F.avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc_nulls_first("avg_confidence"), "source_dataset")
    )


def outlier_counts(g: FactorGraph) -> DataFrame:
    return (
        g.facts.where(F.col("is_outlier") & existing("entity_type") & existing("source_dataset"))
        .groupBy("source_dataset", "entity_type")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "source_dataset", "entity_type")
    )


def multiplier_counts(g: FactorGraph, by: str) -> DataFrame:
    """Facts with a multiplier per ``entity_type`` or ``source_dataset``."""
    return (
        g.facts.where(F.col("multiplier_applied") & existing(by))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), by)
    )


def _first(rows: DataFrame, order: list[Column | str], limit: int | None) -> DataFrame:
    """The first ``limit`` rows, or all of them, unordered."""
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def paths(g: FactorGraph, entity_type: str, limit: int | None = None) -> DataFrame:
    """Fact, type and region of one entity type as a path, first ``limit`` by id."""
    chosen = _first(g.facts.where((F.col("entity_type") == entity_type) & existing("region")), ["ef_id"], limit)
    named = chosen.join(_region_names(g), "region")
    path = F.struct("ef_id", "entity_name", "ef_value", "entity_type", F.col("region").alias("region_code"), "region_name")
    return named.select(path.alias("path"))


def part_of(g: FactorGraph, parent: str, limit: int | None = None) -> DataFrame:
    """Facts of the regions below ``parent``; the child codes are looked up first."""
    children = g.hierarchy.where(F.col("parent_region_code") == parent).select(
        F.col("child_region_code").alias("region")
    )
    rows = g.facts.join(children.distinct(), "region", "left_semi")
    return _first(rows, ["ef_id"], limit).join(_region_names(g), "region").select(
        "ef_id", "entity_name", "ef_value", "ef_unit", F.col("region_name").alias("country")
    )


def regional_factors(g: FactorGraph, region: str, low: float = 0.0, high: float = 100.0, limit: int | None = None) -> DataFrame:
    """Largest non-outlier values of one region inside a range."""
    rows = g.facts.where(
        (F.col("region") == region)
        & ~F.col("is_outlier")
        & (F.col("ef_value") > low)
        & (F.col("ef_value") < high)
        & existing("entity_type")
        & existing("source_dataset")
    ).select("ef_id", "entity_name", "ef_value", "ef_unit", "entity_type", "source_dataset", "confidence")
    return _first(rows, [F.desc("ef_value"), "ef_id"], limit)


def factors_of_region(g: FactorGraph, region: str, limit: int | None = None) -> DataFrame:
    rows = g.facts.where(F.col("region") == region).select("ef_id", "ef_value", "ef_unit", "source_dataset")
    return _first(rows, ["ef_id"], limit)


def industry_reference(g: FactorGraph, entity_type: str, region: str) -> DataFrame:
    """Values of one industry in one region."""
    rows = g.facts.where((F.col("entity_type") == entity_type) & (F.col("region") == region))
    return rows.select("ef_id", "ef_value", F.col("region").alias("region_code"), "entity_type")


def star_rows(g: FactorGraph, limit: int | None = None) -> DataFrame:
    """Flat fact rows with all three ends present, the input of the instruction builder."""
    rows = g.facts.where(existing("region") & existing("entity_type") & existing("source_dataset"))
    if limit:
        rows = rows.orderBy(hash_key(F.col("ef_id"), seed="star"), "ef_id").limit(limit)
    names = _region_names(g)
    return rows.join(names, "region").select(
        "ef_id",
        "entity_id",
        "entity_name",
        "ef_value",
        "ef_unit",
        "confidence",
        "is_outlier",
        "multiplier_applied",
        F.col("region_name").alias("region"),
        F.col("region").alias("region_code"),
        "entity_type",
        F.col("source_dataset").alias("source"),
        "_ord",
    )


def rollup_hierarchy(g: FactorGraph) -> DataFrame:
    """Hierarchy rows with the number of facts and the mean value of the child region."""
    counts = g.facts.where(existing("region")).groupBy(F.col("region").alias("child_region_code")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ef_value").alias("avg_value")
    )
    return g.hierarchy.join(counts, "child_region_code", "left").select(
        "child_region_code",
        "parent_region_code",
        "relationship_type",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "avg_value",
    )


def hierarchy_closure(hierarchy: DataFrame) -> DataFrame:
    """``ancestor, region, depth`` of every region below another over all levels; the least depth where ways differ.

    A hierarchy that leads from a region back to itself is refused.
    """
    levels = hierarchy.select(F.col("parent_region_code").alias("parent"), F.col("child_region_code").alias("child")).distinct()
    found = hierarchy.sparkSession.sql(
        """WITH RECURSIVE below(ancestor, region, way) AS (
          SELECT parent, child, IF(parent = child, raise_error('region hierarchy has a cycle'), array(parent, child)) FROM {levels}
          UNION ALL
          SELECT b.ancestor, l.child, IF(array_contains(b.way, l.child), raise_error('region hierarchy has a cycle'), array_append(b.way, l.child))
          FROM below b JOIN {levels} l ON l.parent = b.region)
        SELECT ancestor, region, size(way) - 1 AS depth FROM below""",
        levels=levels,
    )
    return found.groupBy("ancestor", "region").agg(F.min("depth").alias("depth"))


def part_of_all_levels(g: FactorGraph, parent: str, limit: int | None = None) -> DataFrame:
    """Facts of the regions below ``parent`` at any level, and how far below they are."""
    below = hierarchy_closure(g.hierarchy).where(F.col("ancestor") == parent).select("region", "depth")
    rows = _first(g.facts.join(below, "region"), ["ef_id"], limit)
    return rows.join(_region_names(g), "region").select(
        "ef_id", "entity_name", "ef_value", "ef_unit", F.col("region_name").alias("country"), "depth"
    )


def rollup_all_levels(g: FactorGraph) -> DataFrame:
    """Facts of every region with those of all regions below it: rows, regions met, mean, least and largest value.

    Facts are summed up by region first, so the hierarchy meets one row per region; a
    region that is reached in two ways counts once.
    """
    sums = g.facts.where(existing("region")).groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("ef_value").alias("_n"),
        F.sum("ef_value").alias("_sum"),
        F.min("ef_value").alias("least"),
        F.max("ef_value").alias("most"),
    )
    own = sums.select(F.col("region").alias("ancestor"), "region")
    both = hierarchy_closure(g.hierarchy).select("ancestor", "region").unionByName(own).distinct()
    return both.join(sums, "region").groupBy(F.col("ancestor").alias("region_code")).agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("regions"),
        (F.sum("_sum") / F.sum("_n")).alias("avg_value"),
        F.min("least").alias("least_value"),
        F.max("most").alias("most_value"),
    )
