"""Regional multipliers: preparing the tables and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import (
    GLOBAL_REGION,
    MULTIPLIER_RANGE,
    RATIONALE_CONFIDENCE,
    RATIONALE_MIN_CHARS,
    SOURCE_LABELS,
)
from factorloom.functions.numbers import number_column
from factorloom.functions.tags import sectors, sectors_or_type, tag, with_prefix
from factorloom.operators.ordering import keep_first
from factorloom.operators.sizing import BROADCAST_ROWS, sized_broadcast
from factorloom.session import cut_lineage, stage


def combine(predefined: DataFrame, extracted: DataFrame, order: str = "_ord") -> DataFrame:
    """Stack both lists and keep the first row per region and sector, predefined first."""
    both = predefined.withColumn("_list", F.lit(0)).unionByName(
        extracted.withColumn("_list", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, ["region", "sector"], ["_list", order]).drop("_list")


def clean(df: DataFrame, as_of: Column, order: str = "_ord") -> DataFrame:
    """Normalise, validate and shape a (region, sector, multiplier_factor) list."""
    rated = (
        df.withColumn("region", F.upper("region"))
        .withColumn("sector", F.translate(F.lower("sector"), " ", "_"))
        .withColumn("multiplier_factor", number_column(df, "multiplier_factor"))
        .dropna(subset=["region", "sector", "multiplier_factor"])
        .where(F.col("multiplier_factor").between(*MULTIPLIER_RANGE))
    )
    high, low = RATIONALE_CONFIDENCE
    return rated.select(
        F.concat_ws("_", "region", "sector").alias("entity_id"),
        F.concat_ws(" ", "region", F.translate("sector", "_", " ")).alias("entity_name"),
        F.lit("multiplier").alias("entity_type"),
        F.col("multiplier_factor").alias("ef_value"),
        F.lit("multiplier").alias("ef_unit"),
        "region",
        F.lit(SOURCE_LABELS["predefined"]).alias("source_dataset"),
        F.when(F.length("rationale") > RATIONALE_MIN_CHARS, F.lit(high)).otherwise(F.lit(low)).alias("confidence"),
        as_of.alias("timestamp"),
        F.array(tag("sector", "sector")).alias("tags"),
        "rationale",
        "source_page",
        order,
    )


def multiplier_table(rows: DataFrame, order: str = "_ord", region_key: str = "name") -> DataFrame:
    """Multiplier rows to unique (region, sector, multiplier).

    The last row in input order wins a key. Every sector that occurs outside
    ``Global`` also gets a ``Global`` entry of 1.0 unless a real one exists.
    ``region_key='code'`` reads the region code from the tags instead of the
    region name.
    """
    if region_key == "code":
        region = F.coalesce(F.get(with_prefix("tags", "region_code:"), 0), F.col("region"))
    elif region_key == "name":
        region = F.col("region")
    else:
        raise ValueError(f"unknown region key: {region_key}")
    chosen = rows.where(F.col("entity_type") == "multiplier").select(
        region.alias("region"),
        F.explode(sectors("tags")).alias("sector"),
        F.col("ef_value").alias("multiplier"),
        F.col(order).alias("_o"),
    )
    own = (
        chosen.where(F.col("region").isNotNull() & (F.col("region") != ""))
        .groupBy("region", "sector")
        .agg(F.max_by("multiplier", "_o").alias("multiplier"), F.lit(0).alias("_rank"))
    )
    elsewhere = F.coalesce(F.col("region") != GLOBAL_REGION, F.lit(True))
    fallback = (
        chosen.where(elsewhere)
        .select(F.lit(GLOBAL_REGION).alias("region"), "sector")
        .distinct()
        .withColumn("multiplier", F.lit(1.0))
        .withColumn("_rank", F.lit(1))
    )
    return keep_first(own.unionByName(fallback), ["region", "sector"], ["_rank"]).drop("_rank")


def lookup_region(region: Column | str = "region") -> Column:
    """``US`` is read as ``USA``, for the lookup only."""
    name = F.col(region) if isinstance(region, str) else region
    return F.when(name == "US", F.lit("USA")).otherwise(name)


def apply_regional(
    facts: DataFrame,
    table: DataFrame,
    where: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    written: DataFrame | None = None,
) -> DataFrame:
    """Scale ``ef_value`` by the first candidate sector with a regional entry.

    Candidates are the sector tags, else the entity type. Only if no candidate
    has a regional entry are the ``Global`` ones tried, in the same order.
    The multiplier depends on region and candidates alone, so each distinct pair
    of them is resolved once, whatever the size of ``table``, and joined back:
    by broadcast when the pairs are counted few, else shuffled. Rows outside
    ``where`` pass through with a null flag. The pairs are read from ``written``, a
    table with the same regions, tags and types; without one the facts are written first,
    so that they are computed once.
    """
    eligible = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if written is None:
        written = facts = stage(facts, "facts")
    keyed = _with_pair(facts)
    chosen = _resolved(_with_pair(written).select("_region", "_sectors").distinct(), table)
    joined = keyed.join(sized_broadcast(chosen, max_rows), ["_region", "_sectors"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    scaled = F.when(eligible & hit, F.col("ef_value") * F.col("_by")).otherwise(F.col("ef_value"))
    return (
        joined.withColumn("ef_value", scaled)
        .withColumn("multiplier_applied", F.when(eligible, hit))
        .select(*facts.columns, "multiplier_applied")
    )


def _with_pair(facts: DataFrame) -> DataFrame:
    """Facts with the region and the candidate sectors by which a multiplier is found."""
    region = F.coalesce(lookup_region(), F.lit(""))
    return facts.withColumns({"_region": region, "_sectors": sectors_or_type("tags", "entity_type")})


def _resolved(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``_region, _sectors, _by, _hit`` of the pairs that have an entry."""
    candidates = pairs.select("_region", "_sectors", F.posexplode("_sectors").alias("_pos", "sector"))
    regional = candidates.join(table.withColumnRenamed("region", "_region"), ["_region", "sector"])
    overall = candidates.join(table.where(F.col("region") == GLOBAL_REGION).drop("region"), "sector")
    columns = ["_region", "_sectors", "_pos", "multiplier"]
    return (
        regional.select(*columns, F.lit(0).alias("_level"))
        .unionByName(overall.select(*columns, F.lit(1).alias("_level")))
        .groupBy("_region", "_sectors")
        .agg(F.min(F.struct("_level", "_pos", "multiplier")).alias("_first"))
        .select("_region", "_sectors", F.col("_first.multiplier").alias("_by"), F.lit(True).alias("_hit"))
    )


def unmatched(facts: DataFrame, table: DataFrame) -> DataFrame:
    """(region, entity_type) pairs of facts without a regional or Global entry, with row counts.

    Pairs are counted first, so the anti join sees pairs and not facts.
    """
    pairs = cut_lineage(
        facts.groupBy(
            F.coalesce(lookup_region(), F.lit("")).alias("region"),
            "entity_type",
            sectors_or_type("tags", "entity_type").alias("_sectors"),
        ).agg(F.count(F.lit(1)).alias("rows"))
    )
    exploded = pairs.select("region", "entity_type", "_sectors", F.explode("_sectors").alias("sector"))
    regional = exploded.join(table, ["region", "sector"]).select("region", "entity_type", "_sectors")
    overall = exploded.join(
        table.where(F.col("region") == GLOBAL_REGION).select("sector"), "sector"
    ).select("region", "entity_type", "_sectors")
    matched = regional.unionByName(overall).distinct()
    return (
        pairs.join(matched, ["region", "entity_type", "_sectors"], "left_anti")
        .groupBy("region", "entity_type")
        .agg(F.sum("rows").alias("rows"))
    )


def apply_by_key(
    facts: DataFrame, multipliers: DataFrame, order: str = "_ord", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Older form: exact key ``region_type``, else the first key that starts with
    ``region_`` and contains the type. The old value stays in ``ef_value_original``.

    The prefix test becomes an equality on every prefix of a key that ends at an
    underscore, and runs on distinct (region, type) pairs instead of on facts.
    """
    keyed = (
        multipliers.where(F.col("entity_id").isNotNull() & F.col("ef_value").isNotNull())
        .groupBy(F.col("entity_id").alias("_key"))
        .agg(F.max_by("ef_value", order).alias("_by"), F.min(order).alias("_first"))
    )
    parts = F.split("_key", "_")
    # every non-empty prefix that is followed by an underscore
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_")
    )
    by_prefix = keyed.where(F.col("_key").contains("_")).select(
        "_key", "_by", "_first", F.explode(prefixes).alias("region")
    )
    pairs = facts.select("region", "entity_type").distinct().dropna()
    exact = pairs.withColumn("_key", F.concat_ws("_", "region", "entity_type")).join(keyed, "_key")
    wide = pairs.join(by_prefix, "region").where(F.col("_key").contains(F.col("entity_type")))
    columns = ["region", "entity_type", "_by", "_first"]
    chosen = (
        exact.select(*columns, F.lit(0).alias("_level"))
        .unionByName(wide.select(*columns, F.lit(1).alias("_level")))
        .groupBy("region", "entity_type")
        .agg(F.min_by("_by", F.struct("_level", "_first")).alias("_by"))
    )
    joined = facts.join(sized_broadcast(chosen, max_rows), ["region", "entity_type"], "left")
    return (
        joined.withColumn("ef_value_original", F.col("ef_value"))
        .withColumn("ef_value", F.col("ef_value") * F.coalesce("_by", F.lit(1.0)))
        .select(*facts.columns, "ef_value_original")
    )
