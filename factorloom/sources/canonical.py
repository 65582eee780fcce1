"""Nine source shapes, each mapped onto the canonical columns.

Every function takes a raw table with an order key and returns the canonical
columns, any extras of that source, and the order key. None of them flags
outliers: :func:`factorloom.plans.harmonize.canonical_union` does that for all
sources in one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import (
    BASE_UNIT,
    BASE_UNIT_PER_KG,
    DEFAULT_CONFIDENCE,
    FACTOR_TYPE_DEFAULT,
    FACTOR_TYPE_LADDER,
    MEGATONNE_IN_KG,
    MULTIPLIER_ID_PREFIX,
    MULTIPLIER_METADATA_VERSION,
    PATHWAY_ID_PREFIX,
    PROCESS_ID_PREFIX,
    PRODUCT_REGION_TAG_PREFIX,
    SOURCE_LABELS,
)
from factorloom.functions.numbers import null_nan, number_column
from factorloom.functions.regions import factor_region, multiplier_region_code, standardize_country
from factorloom.functions.tags import category_tags, metadata_json, naics_tag, tag, tag_array
from factorloom.functions.text import clean_name, first_match, part_before, strip, title_case, underscored
from factorloom.functions.units import per_unit
from factorloom.operators.ordering import dense_index, keep_first
from factorloom.schema import as_of_date
from factorloom.sources.resolve import (
    column_or,
    flow_roles,
    has_flow_signature,
    product_region_roles,
    product_roles,
)

ORDER = "_ord"


def _text(c: Column) -> Column:
    return c.cast("string")


def product(
    raw: DataFrame, as_of: str | None = None, roles: dict[str, str] | None = None, order: str = ORDER
) -> DataFrame:
    """Product table of one country; column roles come from the headers."""
    found = product_roles(raw.drop(order).schema, roles)
    if found["id"] is None:
        raw = dense_index(raw, [order], "product_id")
        found["id"] = "product_id"
    category = column_or(raw, found["category"], F.lit("Unknown"))
    quality = (
        number_column(raw, found["quality"]) if found["quality"] else F.lit(DEFAULT_CONFIDENCE["product"])
    )
    return raw.select(
        _text(F.col(found["id"])).alias("entity_id"),
        clean_name(_text(F.col(found["name"]))).alias("entity_name"),
        F.lit("product").alias("entity_type"),
        number_column(raw, found["value"]).alias("ef_value"),
        F.lit(BASE_UNIT_PER_KG).alias("ef_unit"),
        F.lit("FR").alias("region"),
        F.lit(SOURCE_LABELS["product"]).alias("source_dataset"),
        quality.alias("confidence"),
        as_of_date(as_of).alias("timestamp"),
        category_tags(_text(category)).alias("tags"),
        order,
    ).dropna(subset=["entity_id", "ef_value"])


def period_means(raw: DataFrame) -> DataFrame:
    """Monthly rows to yearly means per (country_id, sector, subsector, year)."""
    keys = ["country_id", "sector", "subsector", "year"]
    return (
        raw.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.avg(null_nan(F.col("value"))).alias("value"), F.avg(null_nan(F.col("confidence"))).alias("confidence"))
    )


def period(raw: DataFrame, as_of: str | None = None, rank: int = 0, order: str = ORDER) -> DataFrame:
    """Country, sector and month rows in megatonnes; ordered by their group keys."""
    spaced = {c: title_case(F.replace(F.col(c), F.lit("_"), F.lit(" "))) for c in ("sector", "subsector")}
    key = F.concat_ws("/", F.lit(f"{rank:03d}"), "country_id", "sector", "subsector", _text(F.col("year")))
    return period_means(raw).select(
        F.concat_ws("_", "country_id", "sector", "subsector").alias("entity_id"),
        F.concat(spaced["subsector"], F.lit(" in "), spaced["sector"]).alias("entity_name"),
        F.when(F.col("sector") == "electricity", F.lit("energy")).otherwise(F.col("sector")).alias("entity_type"),
        (F.col("value") * MEGATONNE_IN_KG).alias("ef_value"),
        F.lit(BASE_UNIT).alias("ef_unit"),
        F.upper("country_id").alias("region"),
        F.lit(SOURCE_LABELS["period"]).alias("source_dataset"),
        "confidence",
        as_of_date(as_of).alias("timestamp"),
        F.array(tag("sector", "sector"), tag("subsector", "subsector"), tag("year", "year")).alias("tags"),
        key.alias(order),
    ).dropna(subset=["entity_id", "ef_value", "region"])


def product_region(
    raw: DataFrame,
    as_of: str | None = None,
    region_mode: str = "exact",
    roles: dict[str, str] | None = None,
    order: str = ORDER,
) -> DataFrame:
    """Product-by-country table: standard country codes, first row per product and country."""
    found = product_region_roles(raw.drop(order).schema, roles)
    shaped = (
        raw.dropna(subset=[found["value"]])
        .select(
            strip(_text(column_or(raw, found["product"], F.lit("Unknown product")))).alias("entity_id"),
            number_column(raw, found["value"]).alias("ef_value"),
            standardize_country(_text(column_or(raw, found["region"], F.lit("Unknown region"))), region_mode).alias(
                "region"
            ),
            order,
        )
    )
    return keep_first(shaped, ["entity_id", "region"], [order]).select(
        "entity_id",
        clean_name("entity_id").alias("entity_name"),
        F.lit("product").alias("entity_type"),
        "ef_value",
        F.lit(f"{BASE_UNIT}/EUR").alias("ef_unit"),
        "region",
        F.lit(SOURCE_LABELS["product_region"]).alias("source_dataset"),
        F.lit(DEFAULT_CONFIDENCE["product_region"]).alias("confidence"),
        as_of_date(as_of).alias("timestamp"),
        tag_array(F.concat(F.lit(PRODUCT_REGION_TAG_PREFIX), "region")).alias("tags"),
        order,
    )


def flow(
    raw: DataFrame, as_of: str | None = None, roles: dict[str, str] | None = None, order: str = ORDER
) -> DataFrame:
    """Sector flow files: the import-factor layout when its columns are there, else the legacy one."""
    if has_flow_signature(raw.columns):
        shaped = _import_flows(raw, order)
        shaped = keep_first(shaped, ["entity_id", "_flow", "ef_value"], [order])
    else:
        shaped = _legacy_flows(raw, roles, order)
    return shaped.select(
        "entity_id",
        clean_name("entity_name", "hyphen").alias("entity_name"),
        F.lit("sector").alias("entity_type"),
        "ef_value",
        "ef_unit",
        "region",
        F.lit(SOURCE_LABELS["flow"]).alias("source_dataset"),
        F.lit(DEFAULT_CONFIDENCE["flow"]).alias("confidence"),
        as_of_date(as_of).alias("timestamp"),
        tag_array(
            naics_tag("entity_id"), tag("Flow", "_flow"), tag("Context", "_context"), tag("Level", "_level")
        ).alias("tags"),
        order,
    )


def _import_flows(raw: DataFrame, order: str) -> DataFrame:
    """Rows of a regional file set are US when their file says so, else global.

    Whether any file is a regional one is a fact about the whole table: a
    one-row aggregate used as a scalar.
    """
    any_regional = raw.agg(F.coalesce(F.max(F.col("source_file").startswith("Regional")), F.lit(False))).scalar()
    per_file = F.when(F.col("source_file").contains("US_"), F.lit("US")).otherwise(F.lit("GLB"))
    unit = per_unit("Unit") if "Unit" in raw.columns else F.lit(f"{BASE_UNIT}/USD")
    return raw.select(
        _text(F.col("Sector")).alias("entity_id"),
        F.concat(_text(F.col("Sector")), F.lit(" - "), F.col("Flowable")).alias("entity_name"),
        F.col("Flowable").alias("_flow"),
        number_column(raw, "FlowAmount").alias("ef_value"),
        unit.alias("ef_unit"),
        _text(column_or(raw, "Context", F.lit("Unknown"))).alias("_context"),
        _text(column_or(raw, "BaseIOLevel", F.lit("Unknown"))).alias("_level"),
        F.when(any_regional, per_file).otherwise(F.lit("US")).alias("region"),
        order,
    ).dropna(subset=["entity_id", "ef_value"])


def _legacy_flows(raw: DataFrame, roles: dict[str, str] | None, order: str) -> DataFrame:
    """Exact repeats go before the shared columns are added; the first order key stays."""
    found = flow_roles(raw.drop(order).schema, roles)
    if found["id"] is None:
        raw = dense_index(raw, [order], "_place")
        found["id"] = "_place"
    value = number_column(raw, found["value"]) if found["value"] else F.lit(None).cast("double")
    shaped = raw.select(
        _text(F.col(found["id"])).alias("entity_id"),
        _text(column_or(raw, found["name"], F.lit("Unknown sector"))).alias("entity_name"),
        value.alias("ef_value"),
        order,
    ).dropna(subset=["entity_id", "ef_value"])
    none = F.lit(None).cast("string")
    return (
        keep_first(shaped, ["entity_id", "entity_name", "ef_value"], [order])
        .withColumn("ef_unit", F.lit(f"{BASE_UNIT}/USD"))
        .withColumn("region", F.lit("US"))
        .withColumns({"_flow": none, "_context": none, "_level": none})
    )


def multiplier(raw: DataFrame, as_of: str | None = None, mode: str = "exact", order: str = ORDER) -> DataFrame:
    """Sector multipliers per region, gas and period.

    ``reference`` leaves gas and period empty in the metadata, as the published
    tables have them; ``exact`` fills them in.
    """
    if mode not in ("exact", "reference"):
        raise ValueError(f"unknown metadata mode: {mode}")
    parts = ["region", "sector", "gas_type", "time_period"]
    code = multiplier_region_code("region")
    none = F.lit(None).cast("string")
    carried = {c: F.col(c) if mode == "exact" else none for c in ("gas_type", "time_period")}
    identity = F.concat(F.lit(MULTIPLIER_ID_PREFIX), F.concat_ws("_", *parts))
    return raw.select(
        underscored(identity, " -").alias("entity_id"),
        F.concat("sector", F.lit(" "), "gas_type", F.lit(" in "), "region", F.lit(" ("), "time_period", F.lit(")")).alias(
            "entity_name"
        ),
        F.lit("multiplier").alias("entity_type"),
        null_nan(F.col("multiplier").cast("double")).alias("ef_value"),
        F.lit("ratio").alias("ef_unit"),
        "region",
        F.lit(SOURCE_LABELS["multiplier"]).alias("source_dataset"),
        null_nan(F.col("confidence").cast("double")).alias("confidence"),
        as_of_date(as_of).alias("timestamp"),
        tag_array(*[tag(c, c) for c in ("sector", "region", "gas_type", "time_period")], tag("region_code", code)).alias(
            "tags"
        ),
        metadata_json(
            F.lit(MULTIPLIER_METADATA_VERSION).alias("ipcc_version"),
            F.col("region").alias("region_name"),
            code.alias("region_code"),
            carried["gas_type"].alias("gas_type"),
            carried["time_period"].alias("time_period"),
        ).alias("metadata"),
        order,
    ).dropna(subset=["entity_id", "ef_value", "region"])


def _typed_metadata(label: str) -> Column:
    return metadata_json(F.lit(label).alias("source"), F.col("entity_type"), F.col("tags"))


def factor(raw: DataFrame, as_of: str | None = None, order: str = ORDER) -> DataFrame:
    """Factor database rows: type from the sector text, region name to a group code."""
    shaped = raw.withColumn("_value", number_column(raw, "ef_value")).dropna(subset=["_value", "sector", "gas"]).select(
        _text(F.col("ef_id")).alias("entity_id"),
        clean_name(F.concat("sector", F.lit(" - "), "subsector"), "hyphen").alias("entity_name"),
        first_match("sector", FACTOR_TYPE_LADDER, FACTOR_TYPE_DEFAULT).alias("entity_type"),
        F.col("_value").alias("ef_value"),
        F.col("unit").alias("ef_unit"),
        factor_region("region").alias("region"),
        F.lit(SOURCE_LABELS["factor"]).alias("source_dataset"),
        number_column(raw, "confidence").alias("confidence"),
        as_of_date(as_of).alias("timestamp"),
        F.array(
            tag("sector", underscored(F.lower("sector"))), tag("gas", "gas"), tag("year", "reference_year")
        ).alias("tags"),
        order,
    )
    return shaped.dropna(subset=["entity_id"]).withColumn("metadata", _typed_metadata(SOURCE_LABELS["factor"]))


def pathway(raw: DataFrame, as_of: str | None = None, order: str = ORDER) -> DataFrame:
    """Fuel pathway rows of one country."""
    parts = ["fuel_pathway", "emission_type", "vehicle_technology"]
    shaped = (
        raw.withColumn("_value", number_column(raw, "ghg_emissions"))
        .dropna(subset=["_value", "fuel_pathway"])
        .select(
            F.concat(F.lit(PATHWAY_ID_PREFIX), F.concat_ws("_", *[underscored(c) for c in parts])).alias("entity_id"),
            clean_name(F.concat_ws(" - ", *parts), "hyphen_parens").alias("entity_name"),
            F.lit("fuel_pathway").alias("entity_type"),
            F.col("_value").alias("ef_value"),
            F.col("unit").alias("ef_unit"),
            F.lit("US").alias("region"),
            F.lit(SOURCE_LABELS["pathway"]).alias("source_dataset"),
            number_column(raw, "confidence").alias("confidence"),
            as_of_date(as_of).alias("timestamp"),
            F.array(
                tag("fuel", underscored(F.lower("fuel_pathway"))),
                tag("emission_type", underscored(F.lower("emission_type"))),
                tag("vehicle", underscored(F.lower("vehicle_technology"))),
                tag("year", "year"),
            ).alias("tags"),
            order,
        )
    )
    return shaped.withColumn("metadata", _typed_metadata(SOURCE_LABELS["pathway"]))


def process(raw: DataFrame, as_of: str | None = None, order: str = ORDER) -> DataFrame:
    """Flattened process exchanges."""
    identity = F.concat_ws("_", "category", "process_name", "flow_name")
    parts = F.split("entity_name", " - ")
    has_parts = F.col("entity_name").contains(" - ")
    return (
        raw.select(
            underscored(F.concat(F.lit(PROCESS_ID_PREFIX), identity)).alias("entity_id"),
            clean_name("process_name", "hyphen").alias("entity_name"),
            F.lit("process").alias("entity_type"),
            number_column(raw, "amount").alias("ef_value"),
            F.lit(BASE_UNIT).alias("ef_unit"),
            F.lit("GLB").alias("region"),
            F.lit(SOURCE_LABELS["process"]).alias("source_dataset"),
            F.lit(DEFAULT_CONFIDENCE["process"]).alias("confidence"),
            as_of_date(as_of).alias("timestamp"),
            F.array(tag("category", "category"), tag("flow", "flow_name")).alias("tags"),
            order,
        )
        .dropna(subset=["entity_id", "ef_value"])
        .withColumn(
            "metadata",
            metadata_json(
                F.lit(SOURCE_LABELS["process"]).alias("source"),
                F.when(has_parts, F.get(parts, 1)).otherwise(F.lit("")).alias("process_type"),
                F.when(has_parts, part_before("entity_name", " - ")).otherwise(F.lit("")).alias("category"),
            ),
        )
    )

