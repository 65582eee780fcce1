"""Raw source shapes and a factor table projected from the given tables.

The given tables hold no emission factors. Each projection names a table's
columns after one source shape and picks units, regions and texts by fixed
expressions, so that every rule has rows to work on. The SQL views beside them
say the same for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom import constants as C
from factorloom.catalog.base import table, view
from factorloom.functions.regions import text_literal
from factorloom.functions.tags import empty_tags
from factorloom.plans.graph import FactorGraph
from factorloom.plans.patterns import star_rows
from factorloom.schema import order_key, sortable
from factorloom.sources import canonical, readers
from factorloom.sources.registry import predefined

AS_OF = "2025-03-13"

PRODUCT_COUNTRIES = ["Austria", "DE", " fr ", "Germany", "Atlantis", "EUROPE", "United States", "South Asia"]
UNITS = ["kg CO2e", "g CO2e", "12.5", "t CO2e", "kg", "Mt CO2e", "KG CO2E/t", "ratio"]
FACTOR_SECTORS = [
    "Energy",
    "Industrial Processes",
    "Agriculture",
    "Forestry and Land Use",
    "Waste: Solid",
    "Cross-sector",
]
FACTOR_REGIONS = {"AFRICA": "Africa", "AMERICA": "North America", "ASIA": "Asia", "EUROPE": "Europe"}
MULTIPLIER_REGIONS = ["Global", "USA", "FR", "Europe", "CHN", "India"]
MULTIPLIER_SECTORS = {
    "AUTOMOBILE": "transportation",
    "BUILDING": "buildings",
    "FURNITURE": "product",
    "HOUSEHOLD": "energy",
    "MACHINERY": "manufacturing",
}
EXTRACTED_REGIONS = ["in", "US", "br", "Ca", "ID", "jp"]
FACT_TYPES = {
    "1-URGENT": "energy",
    "2-HIGH": "product",
    "3-MEDIUM": "sector",
    "4-NOT SPECIFIED": "transportation",
    "5-LOW": "waste",
}
FACT_REGIONS = ["USA", "FR", "GLB", "DE", "NAM", "EUR"]
FACT_SOURCES = {"F": "Flow_v2.1", "O": "Trace", "P": "Model_3.8"}


def pick(values: list[str], index: Column) -> Column:
    listed = F.expr("array(" + ", ".join(text_literal(v) for v in values) + ")")
    return F.element_at(listed, index.cast("int") + 1)


def pick_sql(values: list[str], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], cast({index} as int) + 1)"


def switch(c: str, entries: dict[str, str], default: str | None = None) -> Column:
    result = None
    for key, value in entries.items():
        test = F.col(c) == key
        result = F.when(test, F.lit(value)) if result is None else result.when(test, F.lit(value))
    return result.otherwise(F.lit(default))


def switch_sql(c: str, entries: dict[str, str], default: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items())
    last = "NULL" if default is None else f"'{default}'"
    return f"CASE {c} {arms} ELSE {last} END"


def ord_sql(rank: int, *parts: str) -> str:
    return " || '/' || ".join([f"'{rank:03d}'", *parts])


def pad_sql(c: str) -> str:
    return f"lpad(cast({c} as varchar), 19, '0')"


# --- raw shapes --------------------------------------------------------------


def raw_product(spark: SparkSession, sf: str) -> DataFrame:
    dry = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" ("), "p_type", F.lit(",  dry)"))).otherwise(F.lit(""))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("LCI_Code"),
        F.concat("p_name", dry).alias("Product_Name"),
        F.concat_ws(",", "p_type", "p_brand").alias("Category"),
        F.when(F.col("p_partkey") % 97 != 0, F.col("p_retailprice")).alias("Climate_change_total"),
        F.lit("kg").alias("Unit"),
        ((F.col("p_size") % 5) / 5.0).alias("DQR"),
        order_key(1, sortable("p_partkey")).alias("_ord"),
    )


view(
    "raw_product",
    f"""SELECT p_partkey AS code,
  p_name || CASE WHEN p_partkey % 7 = 0 THEN ' (' || p_type || ',  dry)' ELSE '' END AS name,
  p_type || ',' || p_brand AS category,
  CASE WHEN p_partkey % 97 <> 0 THEN p_retailprice END AS value,
  (p_size % 5) / 5.0::double AS quality,
  {ord_sql(1, pad_sql("p_partkey"))} AS _ord
FROM part""",
)


def raw_period(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_discount"
    )
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return lines.join(suppliers.join(nations, "n_nationkey"), "l_suppkey").select(
        F.upper(F.substring("n_name", 1, 3)).alias("country_id"),
        switch("l_returnflag", {"A": "electricity", "N": "transportation"}, "manufacturing").alias("sector"),
        switch("l_linestatus", {"O": "road_freight"}, "heat_supply").alias("subsector"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_extendedprice").alias("value"),
        (0.5 + F.col("l_discount")).alias("confidence"),
    )


view(
    "raw_period",
    f"""SELECT upper(n_name[1:3]) AS country_id,
  {switch_sql("l_returnflag", {"A": "electricity", "N": "transportation"}, "manufacturing")} AS sector,
  {switch_sql("l_linestatus", {"O": "road_freight"}, "heat_supply")} AS subsector,
  year(l_shipdate) AS year, month(l_shipdate) AS month,
  l_extendedprice AS value, 0.5::double + l_discount AS confidence
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""",
)


def raw_product_region(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        pick(PRODUCT_COUNTRIES, F.col("c_custkey") % 8).alias("Country"),
        F.concat(F.lit(" "), F.initcap(F.lower("c_mktsegment")), F.lit(" & Co. "), F.col("c_nationkey").cast("string")).alias(
            "Product"
        ),
        F.when(F.col("c_custkey") % 31 != 0, F.col("c_acctbal")).alias("CO2_Emissions"),
        order_key(3, sortable("c_custkey")).alias("_ord"),
    )


view(
    "raw_product_region",
    f"""SELECT {pick_sql(PRODUCT_COUNTRIES, "c_custkey % 8")} AS country,
  ' ' || upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) || ' & Co. ' || cast(c_nationkey as varchar) AS product,
  CASE WHEN c_custkey % 31 <> 0 THEN c_acctbal END AS value,
  {ord_sql(3, pad_sql("c_custkey"))} AS _ord
FROM customer""",
)


def raw_flow(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    naics = (F.lit(111100) + F.col("o_custkey") % 500).cast("string")
    return table(spark, sf, "orders").select(
        F.when(key % 3 == 0, naics).otherwise(F.col("o_orderpriority")).alias("Sector"),
        switch("o_orderstatus", {"F": "Carbon dioxide", "O": "Methane"}, "Nitrous oxide").alias("Flowable"),
        F.floor(F.col("o_totalprice") / 1000.0).cast("double").alias("FlowAmount"),
        F.when(F.col("o_custkey") % 11 != 0, F.lit("emission/air")).alias("Context"),
        pick(UNITS, F.col("o_custkey") % 8).alias("Unit"),
        F.when(key % 2 == 0, F.lit("Detail")).otherwise(F.lit("Summary")).alias("BaseIOLevel"),
        F.when(key % 4 == 0, F.lit("Regional_US_factors.csv"))
        .when(key % 4 == 1, F.lit("Regional_EU_factors.csv"))
        .otherwise(F.lit("import_factors.csv"))
        .alias("source_file"),
        order_key(4, sortable("o_orderkey")).alias("_ord"),
    )


view(
    "raw_flow",
    f"""SELECT CASE WHEN o_orderkey % 3 = 0 THEN cast(111100 + o_custkey % 500 as varchar) ELSE o_orderpriority END AS sector,
  {switch_sql("o_orderstatus", {"F": "Carbon dioxide", "O": "Methane"}, "Nitrous oxide")} AS flowable,
  cast(floor(o_totalprice / 1000.0::double) as double) AS amount,
  CASE WHEN o_custkey % 11 <> 0 THEN 'emission/air' END AS context,
  {pick_sql(UNITS, "o_custkey % 8")} AS unit,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Detail' ELSE 'Summary' END AS level,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Regional_US_factors.csv' WHEN o_orderkey % 4 = 1 THEN 'Regional_EU_factors.csv'
    ELSE 'import_factors.csv' END AS source_file,
  {ord_sql(4, pad_sql("o_orderkey"))} AS _ord
FROM orders""",
)


def raw_factor(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("s_suppkey")
    return (
        table(spark, sf, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("EFDB-"), key.cast("string")).alias("ef_id"),
            pick(FACTOR_SECTORS, key % 6).alias("sector"),
            F.concat("n_name", F.lit(" / "), "r_name").alias("subsector"),
            pick(["CO2", "CH4", "N2O"], key % 3).alias("gas"),
            F.col("s_acctbal").alias("ef_value"),
            pick(["kg/TJ", "t CO2e/TJ", "g CO2e/kg", "7.25"], key % 4).alias("unit"),
            switch("r_name", FACTOR_REGIONS, "Atlantis").alias("region"),
            (0.5 + (key % 50) / 100.0).alias("confidence"),
            (2000 + key % 20).cast("int").alias("reference_year"),
            order_key(5, sortable("s_suppkey")).alias("_ord"),
        )
    )


view(
    "raw_factor",
    f"""SELECT 'EFDB-' || cast(s_suppkey as varchar) AS ef_id,
  {pick_sql(FACTOR_SECTORS, "s_suppkey % 6")} AS sector, n_name || ' / ' || r_name AS subsector,
  {pick_sql(["CO2", "CH4", "N2O"], "s_suppkey % 3")} AS gas, s_acctbal AS value,
  {pick_sql(["kg/TJ", "t CO2e/TJ", "g CO2e/kg", "7.25"], "s_suppkey % 4")} AS unit,
  {switch_sql("r_name", FACTOR_REGIONS, "Atlantis")} AS region,
  0.5::double + (s_suppkey % 50) / 100.0::double AS confidence,
  2000 + s_suppkey % 20 AS reference_year,
  {ord_sql(5, pad_sql("s_suppkey"))} AS _ord
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)


def raw_pathway(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat("p_type", F.lit(" fuel")).alias("fuel_pathway"),
        F.concat(F.lit("Well (tank) "), "p_brand").alias("emission_type"),
        F.col("p_name").alias("vehicle_technology"),
        F.when(F.col("p_partkey") % 53 != 0, F.col("p_retailprice")).alias("ghg_emissions"),
        F.lit("g CO2e/MJ").alias("unit"),
        (2000 + F.col("p_size")).alias("year"),
        (0.6 + (F.col("p_size") % 40) / 100.0).alias("confidence"),
        order_key(6, sortable("p_partkey")).alias("_ord"),
    )


view(
    "raw_pathway",
    f"""SELECT p_type || ' fuel' AS fuel_pathway, 'Well (tank) ' || p_brand AS emission_type, p_name AS vehicle_technology,
  CASE WHEN p_partkey % 53 <> 0 THEN p_retailprice END AS value, 'g CO2e/MJ' AS unit, 2000 + p_size AS year,
  0.6::double + (p_size % 40) / 100.0::double AS confidence,
  {ord_sql(6, pad_sql("p_partkey"))} AS _ord
FROM part""",
)

FLOW_NAMES = ["Carbon dioxide, fossil", "Water", "Methane", "N2O to air"]


def process_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested process documents, one per event: two exchanges, or flows when there are none."""
    key = F.col("event_id")

    def entry(offset: int, amount: Column, unit: Column) -> Column:
        flow = F.struct(pick(FLOW_NAMES, (key + offset) % 4).alias("name"))
        return F.struct(flow.alias("flow"), amount.alias("amount"), F.struct(unit.alias("name")).alias("unit"))

    pair = F.array(
        entry(0, F.col("value"), F.lit("kg")),
        entry(1, F.when(key % 5 != 0, F.col("value") / 2.0), F.lit(None).cast("string")),
    )
    return table(spark, sf, "events").select(
        F.concat(F.col("event_type"), F.lit(" - step: "), (F.col("user_id") % 10).cast("string")).alias("name"),
        F.struct(F.col("event_type").alias("name")).alias("category"),
        F.when(key % 3 != 0, pair).alias("exchanges"),
        pair.alias("flows"),
        F.lit("process.json").alias("source_file"),
        key.alias("event_id"),
    )


def raw_process(spark: SparkSession, sf: str) -> DataFrame:
    documents = process_documents(spark, sf)
    # the file name carries the key through the explode
    keyed = documents.withColumn("source_file", sortable("event_id")).drop("event_id")
    exploded = readers.explode_exchanges(keyed)
    return exploded.withColumn("_ord", order_key(7, F.col("source_file"), F.col("flow_name"))).drop("source_file")


view(
    "raw_process",
    f"""SELECT event_type || ' - step: ' || cast(user_id % 10 as varchar) AS process_name, event_type AS category,
  flow_name, amount, unit, {ord_sql(7, pad_sql("event_id"), "flow_name")} AS _ord
FROM (
  SELECT *, {pick_sql(FLOW_NAMES, "event_id % 4")} AS flow_name, value AS amount, 'kg' AS unit FROM events
  UNION ALL
  SELECT *, {pick_sql(FLOW_NAMES, "(event_id + 1) % 4")} AS flow_name,
    CASE WHEN event_id % 5 <> 0 THEN value / 2.0::double ELSE 0.0 END AS amount, 'kg' AS unit FROM events
) WHERE flow_name <> 'Water'""",
)


def raw_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        pick(MULTIPLIER_REGIONS, F.col("c_nationkey") % 6).alias("region"),
        switch("c_mktsegment", MULTIPLIER_SECTORS).alias("sector"),
        pick(["CO2", "CH4", "N2O", "F-gases"], key % 4).alias("gas_type"),
        pick(["1990-2000", "2000-2010", "2010-2019", "2019-present"], F.floor(key / 4) % 4).alias("time_period"),
        (0.5 + (key % 150) / 100.0).alias("multiplier"),
        (0.7 + (key % 30) / 100.0).alias("confidence"),
        order_key(8, sortable("c_custkey")).alias("_ord"),
    )


view(
    "raw_multiplier",
    f"""SELECT {pick_sql(MULTIPLIER_REGIONS, "c_nationkey % 6")} AS region,
  {switch_sql("c_mktsegment", MULTIPLIER_SECTORS)} AS sector,
  {pick_sql(["CO2", "CH4", "N2O", "F-gases"], "c_custkey % 4")} AS gas_type,
  {pick_sql(["1990-2000", "2000-2010", "2010-2019", "2019-present"], "(c_custkey // 4) % 4")} AS time_period,
  0.5::double + (c_custkey % 150) / 100.0::double AS multiplier,
  0.7::double + (c_custkey % 30) / 100.0::double AS confidence,
  {ord_sql(8, pad_sql("c_custkey"))} AS _ord
FROM customer""",
)


def predefined_list(spark: SparkSession) -> DataFrame:
    rows = [(*row, f"009/0/{i:019d}") for i, row in enumerate(C.PREDEFINED_MULTIPLIERS)]
    return spark.createDataFrame(
        rows,
        "region string, sector string, multiplier_factor double, rationale string, source_page string, _ord string",
    )


_PREDEFINED_VALUES = ",\n  ".join(
    f"('{r}', '{s}', {m}::double, '{t}', '{p}', '009/0/{i:019d}')"
    for i, (r, s, m, t, p) in enumerate(C.PREDEFINED_MULTIPLIERS)
)
view(
    "predefined_list",
    "SELECT * FROM (VALUES\n  " + _PREDEFINED_VALUES + "\n) v(region, sector, multiplier_factor, rationale, source_page, _ord)",
)


def raw_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Multiplier list read from documents: some factors out of range, some without rationale."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        pick(EXTRACTED_REGIONS, F.col("c_nationkey") % 6).alias("region"),
        F.concat(F.col("c_mktsegment"), F.lit(" line "), (key % 10).cast("string")).alias("sector"),
        (0.3 + (key % 200) / 100.0).alias("multiplier_factor"),
        F.when(key % 4 != 0, F.concat(F.lit("seen in "), "c_name")).alias("rationale"),
        F.when(key % 2 == 0, F.lit("p. 1")).alias("source_page"),
        F.concat(F.lit("009/1/"), sortable("c_custkey")).alias("_ord"),
    )


view(
    "raw_extracted",
    f"""SELECT {pick_sql(EXTRACTED_REGIONS, "c_nationkey % 6")} AS region,
  c_mktsegment || ' line ' || cast(c_custkey % 10 as varchar) AS sector,
  0.3::double + (c_custkey % 200) / 100.0::double AS multiplier_factor,
  CASE WHEN c_custkey % 4 <> 0 THEN 'seen in ' || c_name END AS rationale,
  CASE WHEN c_custkey % 2 = 0 THEN 'p. 1' END AS source_page,
  '009/1/' || {pad_sql("c_custkey")} AS _ord
FROM customer""",
)


# --- a factor table for the graph, quality and instruction queries --------------


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """A merged-table look-alike: orders and parts with flags, gaps and mixed regions."""
    key = F.col("o_orderkey")
    ordered = table(spark, sf, "orders").select(
        F.concat(F.lit("O"), sortable("o_orderkey")).alias("id"),
        F.concat(F.lit("ORD-"), (key % 1000).cast("string")).alias("entity_id"),
        F.concat(F.lit("Item "), (F.col("o_custkey") % 200).cast("string")).alias("entity_name"),
        switch("o_orderpriority", FACT_TYPES).alias("entity_type"),
        (F.col("o_totalprice") / 1000.0).alias("ef_value"),
        F.lit("kg CO2e").alias("ef_unit"),
        F.when(F.col("o_custkey") % 97 != 0, pick(FACT_REGIONS, F.col("o_custkey") % 6)).alias("region"),
        switch("o_orderstatus", FACT_SOURCES).alias("source_dataset"),
        (0.5 + (key % 50) / 100.0).alias("confidence"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"),
        F.when(key % 17 != 0, F.col("o_totalprice") > 450000).alias("is_outlier"),
        F.when(key % 13 != 0, F.col("o_orderstatus") == "P").alias("multiplier_applied"),
        F.array(F.concat(F.lit("sector:"), switch("o_orderpriority", FACT_TYPES))).alias("tags"),
    )
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("P"), sortable("p_partkey")).alias("id"),
        F.concat(F.lit("PRT-"), F.col("p_size").cast("string")).alias("entity_id"),
        F.when(key % 41 != 0, F.col("p_name")).alias("entity_name"),
        F.concat(F.lit("Product - "), "p_type").alias("entity_type"),
        F.when(key % 29 != 0, F.col("p_retailprice") / 100.0).alias("ef_value"),
        pick(["kg CO2e", "12.5", "kg CO2e/kg"], key % 3).alias("ef_unit"),
        pick(["FR", "US", "GLB", "USA"], F.col("p_size") % 4).alias("region"),
        F.concat(F.lit("Catalogue_"), (F.col("p_size") % 3).cast("string")).alias("source_dataset"),
        F.when(key % 19 != 0, F.col("p_size") / 50.0).alias("confidence"),
        F.lit("2020-06-30").alias("timestamp"),
        F.lit(None).cast("boolean").alias("is_outlier"),
        F.lit(None).cast("boolean").alias("multiplier_applied"),
        empty_tags().alias("tags"),
    )
    return ordered.unionByName(parts)


view(
    "facts",
    f"""SELECT 'O' || {pad_sql("o_orderkey")} AS id, 'ORD-' || cast(o_orderkey % 1000 as varchar) AS entity_id,
  'Item ' || cast(o_custkey % 200 as varchar) AS entity_name, {switch_sql("o_orderpriority", FACT_TYPES)} AS entity_type,
  o_totalprice / 1000.0::double AS ef_value, 'kg CO2e' AS ef_unit,
  CASE WHEN o_custkey % 97 <> 0 THEN {pick_sql(FACT_REGIONS, "o_custkey % 6")} END AS region,
  {switch_sql("o_orderstatus", FACT_SOURCES)} AS source_dataset,
  0.5::double + (o_orderkey % 50) / 100.0::double AS confidence, strftime(o_orderdate, '%Y-%m-%d') AS timestamp,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice > 450000 END AS is_outlier,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus = 'P' END AS multiplier_applied
FROM orders
UNION ALL
SELECT 'P' || {pad_sql("p_partkey")}, 'PRT-' || cast(p_size as varchar),
  CASE WHEN p_partkey % 41 <> 0 THEN p_name END, 'Product - ' || p_type,
  CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice / 100.0::double END,
  {pick_sql(["kg CO2e", "12.5", "kg CO2e/kg"], "p_partkey % 3")}, {pick_sql(["FR", "US", "GLB", "USA"], "p_size % 4")},
  'Catalogue_' || cast(p_size % 3 as varchar), CASE WHEN p_partkey % 19 <> 0 THEN p_size / 50.0::double END,
  '2020-06-30', NULL, NULL
FROM part""",
)


def graph(spark: SparkSession, sf: str) -> FactorGraph:
    return FactorGraph.build(facts(spark, sf))


view(
    "g_facts",
    """SELECT 'ef_' || md5(id) AS ef_id, entity_id, coalesce(entity_name, '') AS entity_name,
  coalesce(ef_value, 0.0) AS ef_value, ef_unit, coalesce(confidence, 0.5) AS confidence,
  coalesce(is_outlier, false) AS is_outlier, coalesce(multiplier_applied, false) AS multiplier_applied,
  timestamp, region, entity_type, source_dataset, id AS _ord
FROM facts""",
)
view(
    "g_regions",
    """SELECT region AS region_code,
  CASE region WHEN 'USA' THEN 'United States' WHEN 'FR' THEN 'France' WHEN 'GLB' THEN 'Global' ELSE region END AS name,
  CASE region WHEN 'USA' THEN 'North America' WHEN 'FR' THEN 'Europe' WHEN 'GLB' THEN 'Global' ELSE 'Unknown' END AS continent,
  region = 'GLB' AS is_global
FROM (SELECT DISTINCT region FROM facts WHERE region IS NOT NULL)""",
)
view(
    "g_types",
    """SELECT 'type_' || cast(row_number() OVER (ORDER BY f) as varchar) AS type_id, entity_type AS type_name,
  'Emission factors for ' || entity_type AS description
FROM (SELECT entity_type, min(id) AS f FROM facts WHERE entity_type IS NOT NULL GROUP BY 1)""",
)
view(
    "g_sources",
    r"""SELECT 'source_' || cast(row_number() OVER (ORDER BY f) as varchar) AS source_id, source_dataset AS name,
  CASE WHEN contains(source_dataset, '_') AND regexp_matches(string_split(source_dataset, '_')[-1], '^[0-9]')
    THEN string_split(source_dataset, '_')[-1] ELSE '1.0' END AS version,
  'https://example.com/datasets/' || replace(lower(source_dataset), ' ', '_') AS url
FROM (SELECT source_dataset, min(id) AS f FROM facts WHERE source_dataset IS NOT NULL GROUP BY 1)""",
)
_HIERARCHY_VALUES = ", ".join(f"('{c}', '{p}', '{r}')" for c, p, r in C.REGION_HIERARCHY)
view(
    "g_hierarchy",
    f"SELECT * FROM (VALUES {_HIERARCHY_VALUES}) v(child_region_code, parent_region_code, relationship_type)",
)


def star(spark: SparkSession, sf: str) -> DataFrame:
    return star_rows(graph(spark, sf), limit=None)


view(
    "star",
    """SELECT ef_id, entity_id, entity_name, ef_value, ef_unit, confidence, is_outlier, multiplier_applied,
  r.name AS region, f.region AS region_code, entity_type, source_dataset AS source, _ord
FROM g_facts f JOIN g_regions r ON r.region_code = f.region
WHERE entity_type IS NOT NULL AND source_dataset IS NOT NULL""",
)


# --- canonical datasets ----------------------------------------------------------


def clean_sql(x: str, keep: str = "") -> str:
    kept = "".join("\\" + ch for ch in keep)
    return rf"trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s{kept}]', ' ', 'g'), '\s+', ' ', 'g'))"


def country_sql(x: str, mode: str = "reference") -> str:
    arms = []
    for code in C.COUNTRY_CODES:
        arms.append(f"WHEN contains({x}, '{code}') THEN '{code}'" if mode == "reference" else f"WHEN {x} = '{code}' THEN '{code}'")
    for code, name in C.COUNTRY_CODES.items():
        arms.append(f"WHEN {x} = '{name.upper()}' THEN '{code}'")
    for words, code in C.REST_OF_WORLD_LADDER:
        test = " OR ".join(f"contains({x}, '{w}')" for w in words)
        arms.append(f"WHEN {test} THEN '{code}'")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(arms)} ELSE 'ROW' END"


def canonical_product(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.product(raw_product(spark, sf), AS_OF)


view(
    "can_product",
    f"""SELECT cast(code as varchar) AS entity_id, {clean_sql("name")} AS entity_name, 'product' AS entity_type,
  value AS ef_value, 'kg CO2e/kg' AS ef_unit, 'FR' AS region, 'Agribalyse_3.1' AS source_dataset,
  quality AS confidence, '{AS_OF}' AS timestamp, string_split(category, ',') AS tags, _ord
FROM raw_product WHERE value IS NOT NULL""",
)


def canonical_period(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.period(raw_period(spark, sf), AS_OF, rank=2)


view(
    "period_means",
    """SELECT country_id, sector, subsector, year, avg(value) AS value, avg(confidence) AS confidence
FROM raw_period GROUP BY 1, 2, 3, 4""",
)
view(
    "can_period",
    f"""SELECT country_id || '_' || sector || '_' || subsector AS entity_id,
  CASE subsector WHEN 'road_freight' THEN 'Road Freight' ELSE 'Heat Supply' END || ' in '
    || upper(sector[1:1]) || sector[2:] AS entity_name,
  CASE WHEN sector = 'electricity' THEN 'energy' ELSE sector END AS entity_type,
  value * 1e9 AS ef_value, 'kg CO2e' AS ef_unit, upper(country_id) AS region, 'Climate_TRACE' AS source_dataset,
  confidence, '{AS_OF}' AS timestamp,
  ['sector:' || sector, 'subsector:' || subsector, 'year:' || cast(year as varchar)] AS tags,
  {ord_sql(2, "country_id", "sector", "subsector", "cast(year as varchar)")} AS _ord
FROM period_means""",
)


def canonical_product_region(spark: SparkSession, sf: str, mode: str = "reference") -> DataFrame:
    return canonical.product_region(raw_product_region(spark, sf), AS_OF, region_mode=mode)


view(
    "can_product_region",
    f"""SELECT entity_id, {clean_sql("entity_id")} AS entity_name, 'product' AS entity_type, value AS ef_value,
  'kg CO2e/EUR' AS ef_unit, region, 'EXIOBASE_3.8' AS source_dataset, 0.75::double AS confidence, '{AS_OF}' AS timestamp,
  ['EXIOBASE region:' || region] AS tags, _ord
FROM (SELECT trim(product) AS entity_id, value, {country_sql("upper(trim(country))")} AS region, _ord
  FROM raw_product_region WHERE value IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY entity_id, region ORDER BY _ord) = 1""",
)


def canonical_flow(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.flow(raw_flow(spark, sf), AS_OF)


view(
    "can_flow",
    rf"""SELECT sector AS entity_id, {clean_sql("sector || ' - ' || flowable", "-")} AS entity_name, 'sector' AS entity_type,
  amount AS ef_value, unit || '/USD' AS ef_unit,
  CASE WHEN (SELECT max(starts_with(source_file, 'Regional')) FROM raw_flow)
    THEN CASE WHEN contains(source_file, 'US_') THEN 'US' ELSE 'GLB' END ELSE 'US' END AS region,
  'USEEIO_v2.1' AS source_dataset, 0.7::double AS confidence, '{AS_OF}' AS timestamp,
  list_filter([CASE WHEN regexp_full_match(sector, '[0-9]{{2,}}') THEN 'NAICS:' || sector[1:2] END, 'Flow:' || flowable,
    'Context:' || context, 'Level:' || level], lambda x: x IS NOT NULL) AS tags, _ord
FROM raw_flow
QUALIFY row_number() OVER (PARTITION BY sector, flowable, amount ORDER BY _ord) = 1""",
)


def canonical_factor(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.factor(raw_factor(spark, sf), AS_OF)


_FACTOR_CODES = {k: v for k, v in C.FACTOR_REGION_CODES.items()}
view(
    "can_factor",
    f"""SELECT ef_id AS entity_id, {clean_sql("sector || ' - ' || subsector", "-")} AS entity_name,
  CASE WHEN contains(sector, 'Energy') THEN 'energy' WHEN contains(sector, 'Industrial') THEN 'industrial_process'
    WHEN contains(sector, 'Agriculture') OR contains(sector, 'Forestry') THEN 'agriculture'
    WHEN contains(sector, 'Waste') THEN 'waste' ELSE 'other' END AS entity_type,
  value AS ef_value, unit AS ef_unit, {switch_sql("region", _FACTOR_CODES, "GLB")} AS region,
  'IPCC_EFDB' AS source_dataset, confidence, '{AS_OF}' AS timestamp,
  ['sector:' || replace(lower(sector), ' ', '_'), 'gas:' || gas, 'year:' || cast(reference_year as varchar)] AS tags, _ord
FROM raw_factor WHERE value IS NOT NULL AND sector IS NOT NULL AND gas IS NOT NULL""",
)


def canonical_pathway(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.pathway(raw_pathway(spark, sf), AS_OF)


_U = "replace(lower({0}), ' ', '_')"
view(
    "can_pathway",
    f"""SELECT 'GREET_' || replace(fuel_pathway, ' ', '_') || '_' || replace(emission_type, ' ', '_') || '_'
    || replace(vehicle_technology, ' ', '_') AS entity_id,
  {clean_sql("fuel_pathway || ' - ' || emission_type || ' - ' || vehicle_technology", "-()")} AS entity_name,
  'fuel_pathway' AS entity_type, value AS ef_value, unit AS ef_unit, 'US' AS region, 'GREET_Model' AS source_dataset,
  confidence, '{AS_OF}' AS timestamp,
  ['fuel:' || {_U.format("fuel_pathway")}, 'emission_type:' || {_U.format("emission_type")},
   'vehicle:' || {_U.format("vehicle_technology")}, 'year:' || cast(year as varchar)] AS tags, _ord
FROM raw_pathway WHERE value IS NOT NULL""",
)


def canonical_process(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.process(raw_process(spark, sf), AS_OF)


view(
    "can_process",
    f"""SELECT replace('OPENLCA_' || category || '_' || process_name || '_' || flow_name, ' ', '_') AS entity_id,
  {clean_sql("process_name", "-")} AS entity_name, 'process' AS entity_type, amount AS ef_value, 'kg CO2e' AS ef_unit,
  'GLB' AS region, 'OpenLCA' AS source_dataset, 0.7::double AS confidence, '{AS_OF}' AS timestamp,
  ['category:' || category, 'flow:' || flow_name] AS tags, _ord
FROM raw_process""",
)


def canonical_multiplier(spark: SparkSession, sf: str, mode: str = "reference") -> DataFrame:
    return canonical.multiplier(raw_multiplier(spark, sf), AS_OF, mode)


_MULTIPLIER_CODES = switch_sql("region", C.MULTIPLIER_REGION_CODES)
view(
    "can_multiplier",
    f"""SELECT replace(replace('IPCC_AR6_' || region || '_' || sector || '_' || gas_type || '_' || time_period, ' ', '_'), '-', '_')
    AS entity_id,
  sector || ' ' || gas_type || ' in ' || region || ' (' || time_period || ')' AS entity_name, 'multiplier' AS entity_type,
  multiplier AS ef_value, 'ratio' AS ef_unit, region, 'IPCC_AR6' AS source_dataset, confidence, '{AS_OF}' AS timestamp,
  list_filter(['sector:' || sector, 'region:' || region, 'gas_type:' || gas_type, 'time_period:' || time_period,
    'region_code:' || {_MULTIPLIER_CODES}], lambda x: x IS NOT NULL) AS tags, _ord
FROM raw_multiplier""",
)


def canonical_predefined(spark: SparkSession, sf: str) -> DataFrame:
    from factorloom.operators.multipliers import combine

    return predefined(combine(predefined_list(spark), raw_extracted(spark, sf)), AS_OF)


view(
    "combined",
    """SELECT * FROM (SELECT * FROM predefined_list UNION ALL SELECT * FROM raw_extracted)
QUALIFY row_number() OVER (PARTITION BY region, sector ORDER BY _ord) = 1""",
)
view(
    "can_predefined",
    f"""SELECT region || '_' || sector AS entity_id, region || ' ' || replace(sector, '_', ' ') AS entity_name,
  'multiplier' AS entity_type, multiplier_factor AS ef_value, 'multiplier' AS ef_unit, region,
  'IPCC_AR6' AS source_dataset, CASE WHEN length(rationale) > 20 THEN 0.9::double ELSE 0.7::double END AS confidence,
  '{AS_OF}' AS timestamp, ['sector:' || sector] AS tags, rationale, source_page, _ord
FROM (SELECT upper(region) AS region, replace(lower(sector), ' ', '_') AS sector, multiplier_factor, rationale,
    source_page, _ord FROM combined)
WHERE multiplier_factor BETWEEN 0.5 AND 2.0""",
)

DATASETS = {
    "product": canonical_product,
    "period": canonical_period,
    "product_region": canonical_product_region,
    "flow": canonical_flow,
    "factor": canonical_factor,
    "pathway": canonical_pathway,
    "process": canonical_process,
    "multiplier": canonical_multiplier,
    "predefined": canonical_predefined,
}


def datasets(spark: SparkSession, sf: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: DATASETS[name](spark, sf) for name in (names or DATASETS)}


_COMMON = (
    "entity_id, entity_name, entity_type, ef_value, ef_unit, region, source_dataset, confidence, timestamp, tags, _ord"
)
view(
    "canonical_rows",
    "\nUNION ALL\n".join(f"SELECT '{name}' AS dataset, {_COMMON} FROM can_{name}" for name in DATASETS),
)


def outlier_sql(source: str, by: str | None, z: float, value: str = "ef_value") -> str:
    """Rows of ``source`` with a computed flag ``flagged``."""
    group = f"{by} AS g," if by else "1 AS g,"
    join = f"s.g = t.{by}" if by else "true"
    where = f"AND {by} IS NOT NULL" if by else ""
    return f"""SELECT t.*, coalesce(s.n >= 10 AND (
    (s.sd > 0 AND abs((t.{value} - s.mean) / nullif(s.sd, 0)) > {z})
    OR (s.q3 - s.q1 > 0 AND (t.{value} < s.q1 - 1.5 * (s.q3 - s.q1) OR t.{value} > s.q3 + 1.5 * (s.q3 - s.q1)))), false) AS flagged
FROM {source} t LEFT JOIN (
  SELECT {group} count({value}) AS n, avg({value}) AS mean, stddev_pop({value}) AS sd,
    quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3
  FROM {source} WHERE {value} IS NOT NULL {where} GROUP BY 1) s ON {join}"""


view("canonical_flagged", outlier_sql("canonical_rows", "dataset", C.OUTLIER_Z))


def unit_sql(value: str, unit: str) -> tuple[str, str]:
    named = f"CASE WHEN regexp_full_match({unit}, '[0-9.]+') THEN 'kg CO2e' ELSE {unit} END"
    grams, tonnes = f"contains(lower({named}), 'g co2e')", f"contains(lower({named}), 't co2e')"
    return (
        f"CASE WHEN {grams} THEN {value} * 0.001::double WHEN {tonnes} THEN {value} * 1000.0::double ELSE {value} END",
        f"CASE WHEN {grams} OR {tonnes} THEN 'kg CO2e' ELSE {named} END",
    )


_UV, _UU = unit_sql("ef_value", "ef_unit")
view(
    "unit_rows",
    f"""SELECT dataset, entity_id, entity_name, entity_type, {_UV} AS ef_value, {_UU} AS ef_unit, region, source_dataset,
  confidence, timestamp, tags, CASE WHEN dataset NOT IN ('product_region', 'flow', 'predefined') THEN flagged END AS is_outlier, _ord
FROM canonical_flagged""",
)
view(
    "multiplier_own",
    """SELECT region, replace(t, 'sector:', '') AS sector, arg_max(ef_value, _ord) AS multiplier
FROM (SELECT region, unnest(tags) AS t, ef_value, _ord FROM can_multiplier) WHERE starts_with(t, 'sector:') GROUP BY 1, 2""",
)
view(
    "multiplier_keys",
    """SELECT * FROM multiplier_own
UNION ALL
SELECT DISTINCT 'Global', sector, 1.0::double FROM multiplier_own WHERE region <> 'Global'
  AND sector NOT IN (SELECT sector FROM multiplier_own WHERE region = 'Global')""",
)
view(
    "candidates",
    """SELECT _ord, region, unnest(s) AS sector, generate_subscripts(s, 1) AS pos FROM (
  SELECT _ord, CASE WHEN region = 'US' THEN 'USA' ELSE region END AS region,
    CASE WHEN len(list_filter(tags, lambda x: starts_with(x, 'sector:'))) > 0
      THEN list_transform(list_filter(tags, lambda x: starts_with(x, 'sector:')), lambda x: replace(x, 'sector:', ''))
      ELSE [entity_type] END AS s
  FROM unit_rows WHERE dataset <> 'multiplier')""",
)
view(
    "chosen_multiplier",
    """SELECT _ord, arg_min(multiplier, rank) AS multiplier FROM (
  SELECT c._ord, m.multiplier, c.pos AS rank FROM candidates c JOIN multiplier_keys m ON m.region = c.region AND m.sector = c.sector
  UNION ALL
  SELECT c._ord, m.multiplier, 1000 + c.pos FROM candidates c JOIN multiplier_keys m ON m.region = 'Global' AND m.sector = c.sector)
GROUP BY 1""",
)
view(
    "harmonized",
    """SELECT 'EF' || lpad(cast(row_number() OVER (ORDER BY u._ord) as varchar), 8, '0') AS id, u.entity_id, u.entity_name,
  u.entity_type, CASE WHEN m.multiplier IS NOT NULL THEN u.ef_value * m.multiplier ELSE u.ef_value END AS ef_value, u.ef_unit,
  u.region, u.source_dataset, u.confidence, u.timestamp, u.tags, u.is_outlier,
  CASE WHEN u.dataset <> 'multiplier' THEN m.multiplier IS NOT NULL END AS multiplier_applied, u.dataset, u._ord
FROM unit_rows u LEFT JOIN chosen_multiplier m ON m._ord = u._ord""",
)
