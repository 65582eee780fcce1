"""Graph queries: node and edge tables, integrity and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom import constants as C
from factorloom.catalog import inputs as I
from factorloom.catalog.base import query, table
from factorloom.plans import graph as G
from factorloom.plans import patterns as P
from factorloom.plans.graph import FactorGraph

_EDGE_SOURCE = """SELECT f.ef_id, coalesce(s.source_id, '') AS source_id, f.timestamp
FROM g_facts f LEFT JOIN g_sources s ON s.name = f.source_dataset"""
_EDGE_TYPE = """SELECT f.ef_id, coalesce(t.type_id, '') AS type_id, f.confidence
FROM g_facts f LEFT JOIN g_types t ON t.type_name = f.entity_type"""


@query(
    "graph_nodes_ef",
    """SELECT ef_id, entity_id, entity_name, ef_value, ef_unit, confidence, is_outlier, multiplier_applied, timestamp FROM g_facts""",
)
def graph_nodes_ef(spark, sf):
    return I.graph(spark, sf).facts.drop("region", "entity_type", "source_dataset", "_ord")


@query(
    "graph_typed_load",
    """SELECT ef_id, ef_value, confidence, is_outlier, multiplier_applied FROM g_facts""",
)
def graph_typed_load(spark, sf):
    """Node rows as text, as a CSV holds them, read back as numbers and flags."""
    nodes = I.graph(spark, sf).facts
    flags = {c: F.initcap(F.col(c).cast("string")) for c in ("is_outlier", "multiplier_applied")}
    numbers = {c: F.col(c).cast("string") for c in ("ef_value", "confidence")}
    typed = G.load_typed(nodes.withColumns({**flags, **numbers}))
    return typed.select("ef_id", "ef_value", "confidence", "is_outlier", "multiplier_applied")


@query("graph_dim_regions", "SELECT region_code, name, continent, is_global FROM g_regions")
def graph_dim_regions(spark, sf):
    return G.region_nodes(G.fact_nodes(I.facts(spark, sf)))


@query("graph_dim_types", "SELECT type_id, type_name, description FROM g_types")
def graph_dim_types(spark, sf):
    return G.type_nodes(G.fact_nodes(I.facts(spark, sf)))


@query("graph_dim_sources", "SELECT source_id, name, version, url FROM g_sources")
def graph_dim_sources(spark, sf):
    return G.source_nodes(G.fact_nodes(I.facts(spark, sf)))


@query("graph_edges_region", "SELECT ef_id, region AS region_code, confidence FROM g_facts")
def graph_edges_region(spark, sf):
    return I.graph(spark, sf).edges_to_region()


@query("graph_edges_type", _EDGE_TYPE)
def graph_edges_type(spark, sf):
    return I.graph(spark, sf).edges_to_type()


@query("graph_edges_source", _EDGE_SOURCE)
def graph_edges_source(spark, sf):
    return I.graph(spark, sf).edges_to_source()


@query(
    "graph_region_hierarchy",
    """SELECT child_region_code, parent_region_code, relationship_type, coalesce(c.n, 0) AS rows, round(c.a, 6) AS avg_value
FROM g_hierarchy LEFT JOIN (SELECT region, count(*) AS n, avg(ef_value) AS a FROM g_facts GROUP BY 1) c ON c.region = child_region_code""",
)
def graph_region_hierarchy(spark, sf):
    rolled = P.rollup_hierarchy(I.graph(spark, sf))
    return rolled.withColumn("avg_value", F.round("avg_value", 6))


_COUNTS = """SELECT 'regions' AS name, count(*) AS rows FROM g_regions
UNION ALL SELECT 'entity_types', count(*) FROM g_types
UNION ALL SELECT 'sources', count(*) FROM g_sources
UNION ALL SELECT t, (SELECT count(*) FROM g_facts) FROM (VALUES ('emission_factors'), ('ef_to_region'), ('ef_to_entity_type'), ('ef_to_source')) v(t)
UNION ALL SELECT 'region_hierarchy', count(*) FROM g_hierarchy"""


@query("graph_table_counts", _COUNTS)
def graph_table_counts(spark, sf):
    return I.graph(spark, sf).table_counts()


@query(
    "graph_node_counts",
    """SELECT 'EmissionFactor' AS label, count(*) AS rows FROM g_facts UNION ALL SELECT 'Region', count(*) FROM g_regions
UNION ALL SELECT 'EntityType', count(*) FROM g_types UNION ALL SELECT 'Source', count(*) FROM g_sources""",
)
def graph_node_counts(spark, sf):
    return P.node_counts(I.graph(spark, sf))


@query(
    "graph_edge_counts",
    """SELECT 'APPLIES_TO_REGION' AS relation, count(region) AS rows FROM g_facts
UNION ALL SELECT 'HAS_ENTITY_TYPE', count(entity_type) FROM g_facts
UNION ALL SELECT 'SOURCED_FROM', count(source_dataset) FROM g_facts
UNION ALL SELECT 'PART_OF', count(*) FROM g_hierarchy WHERE child_region_code IN (SELECT region_code FROM g_regions)
  AND parent_region_code IN (SELECT region_code FROM g_regions)""",
)
def graph_edge_counts(spark, sf):
    return P.edge_counts(I.graph(spark, sf))


@query(
    "graph_key_check",
    """SELECT 'EmissionFactor' AS label, count(*) AS rows, count(DISTINCT ef_id) AS distinct_keys, count(*) = count(DISTINCT ef_id) AS is_unique FROM g_facts
UNION ALL SELECT 'Region', count(*), count(DISTINCT region_code), count(*) = count(DISTINCT region_code) FROM g_regions
UNION ALL SELECT 'EntityType', count(*), count(DISTINCT type_id), count(*) = count(DISTINCT type_id) FROM g_types
UNION ALL SELECT 'Source', count(*), count(DISTINCT source_id), count(*) = count(DISTINCT source_id) FROM g_sources
UNION ALL SELECT 'entity_id', count(*), count(DISTINCT entity_id), count(*) = count(DISTINCT entity_id) FROM g_facts""",
)
def graph_key_check(spark, sf):
    g = I.graph(spark, sf)
    return G.key_check(
        [
            ("EmissionFactor", g.facts, "ef_id"),
            ("Region", g.regions, "region_code"),
            ("EntityType", g.types, "type_id"),
            ("Source", g.sources, "source_id"),
            ("entity_id", g.facts, "entity_id"),
        ]
    )


@query(
    "graph_edge_integrity",
    """SELECT count(*) AS edges, count(*) FILTER (region IN (SELECT region_code FROM g_regions) AND ef_value > 1) AS loaded,
  count(*) FILTER (NOT coalesce(region IN (SELECT region_code FROM g_regions) AND ef_value > 1, false)) AS dangling FROM g_facts""",
)
def graph_edge_integrity(spark, sf):
    """Region edges against nodes of which the small values were not loaded."""
    g = I.graph(spark, sf)
    return G.edge_integrity(
        g.edges_to_region(), g.facts.where("ef_value > 1"), g.regions, "ef_id", "region_code"
    )


@query(
    "graph_star_extract",
    """SELECT ef_id, entity_id, entity_name, ef_value, ef_unit, confidence, is_outlier, multiplier_applied, region, entity_type, source FROM star
ORDER BY md5(ef_id || '|star'), ef_id LIMIT 25000""",
)
def graph_star_extract(spark, sf):
    return P.star_rows(I.graph(spark, sf), limit=25_000).drop("region_code", "_ord")


@query(
    "graph_region_compare",
    """SELECT r.name AS region_name, round(avg(ef_value), 6) AS avg_value, count(*) AS rows FROM g_facts f JOIN g_regions r ON r.region_code = f.region
WHERE entity_type = 'energy' AND region IN ('USA', 'FR', 'GLB') GROUP BY 1""",
)
def graph_region_compare(spark, sf):
    compared = P.compare_regions(I.graph(spark, sf), "energy", ["USA", "FR", "GLB"])
    return compared.withColumn("avg_value", F.round("avg_value", 6))


@query(
    "graph_region_vs_global",
    """SELECT a.entity_type, round(a.v, 6) AS region_avg, round(b.v, 6) AS other_avg, round(a.v / nullif(b.v, 0), 9) AS ratio,
  a.n * b.n AS pairs, a.n AS n1
FROM (SELECT entity_type, avg(ef_value) AS v, count(*) AS n FROM g_facts WHERE region = 'USA' GROUP BY 1) a
JOIN (SELECT entity_type, avg(ef_value) AS v, count(*) AS n FROM g_facts WHERE region = 'GLB' GROUP BY 1) b USING (entity_type)
ORDER BY abs(a.v / nullif(b.v, 0) - 1) DESC LIMIT 10""",
)
def graph_region_vs_global(spark, sf):
    compared = P.region_against(I.graph(spark, sf), "USA", "GLB", limit=10)
    return compared.withColumns(
        {
            "region_avg": F.round("region_avg", 6),
            "other_avg": F.round("other_avg", 6),
            "ratio": F.round("ratio", 9),
        }
    )


@query(
    "graph_type_stats",
    """SELECT entity_type, count(*) AS rows, round(avg(ef_value), 6) AS avg_value, min(ef_value) AS min_value, max(ef_value) AS max_value
FROM g_facts WHERE NOT is_outlier AND entity_type IS NOT NULL GROUP BY 1""",
)
def graph_type_stats(spark, sf):
    return P.type_statistics(I.graph(spark, sf)).withColumn("avg_value", F.round("avg_value", 6))


@query(
    "graph_value_bands",
    """SELECT entity_type, CASE WHEN ef_value < 1 THEN 'Very Low (<1)' WHEN ef_value < 10 THEN 'Low (1-10)' WHEN ef_value < 100
  THEN 'Medium (10-100)' WHEN ef_value < 1000 THEN 'High (100-1000)' ELSE 'Very High (>1000)' END AS value_range, count(*) AS rows
FROM g_facts WHERE entity_type IS NOT NULL GROUP BY 1, 2""",
)
def graph_value_bands(spark, sf):
    return P.value_bands(I.graph(spark, sf))


@query(
    "graph_source_confidence",
    """SELECT source_dataset, round(avg(confidence), 9) AS avg_confidence, count(*) AS rows FROM g_facts WHERE source_dataset IS NOT NULL GROUP BY 1""",
)
def graph_source_confidence(spark, sf):
    return P.source_confidence(I.graph(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(
    "graph_outliers",
    "SELECT source_dataset, entity_type, count(*) AS rows FROM g_facts WHERE is_outlier GROUP BY 1, 2",
)
def graph_outliers(spark, sf):
    return P.outlier_counts(I.graph(spark, sf))


@query("graph_mult_by_type", "SELECT entity_type, count(*) AS rows FROM g_facts WHERE multiplier_applied GROUP BY 1")
def graph_mult_by_type(spark, sf):
    return P.multiplier_counts(I.graph(spark, sf), "entity_type")


@query("graph_mult_by_source", "SELECT source_dataset, count(*) AS rows FROM g_facts WHERE multiplier_applied GROUP BY 1")
def graph_mult_by_source(spark, sf):
    return P.multiplier_counts(I.graph(spark, sf), "source_dataset")


@query(
    "graph_paths",
    """SELECT ef_id, entity_name, ef_value, entity_type, region AS region_code, r.name AS region_name
FROM g_facts f JOIN g_regions r ON r.region_code = f.region WHERE entity_type = 'energy' ORDER BY ef_id LIMIT 10""",
)
def graph_paths(spark, sf):
    return P.paths(I.graph(spark, sf), "energy", limit=10).select("path.*")


@query(
    "graph_part_of",
    """SELECT ef_id, entity_name, ef_value, ef_unit, r.name AS country FROM g_facts f JOIN g_regions r ON r.region_code = f.region
WHERE region IN (SELECT child_region_code FROM g_hierarchy WHERE parent_region_code = 'EUR') ORDER BY ef_id LIMIT 20""",
)
def graph_part_of(spark, sf):
    return P.part_of(I.graph(spark, sf), "EUR", limit=20)


@query(
    "graph_perf_query",
    """SELECT ef_id, entity_name, ef_value, ef_unit, entity_type, source_dataset, confidence FROM g_facts
WHERE region = 'USA' AND NOT is_outlier AND ef_value > 0 AND ef_value < 100 ORDER BY ef_value DESC, ef_id LIMIT 20""",
)
def graph_perf_query(spark, sf):
    return P.regional_factors(I.graph(spark, sf), "USA", limit=20)


@query(
    "graph_region_lookup",
    "SELECT ef_id, ef_value, ef_unit, source_dataset FROM g_facts WHERE region = 'FR' ORDER BY ef_id LIMIT 10",
)
def graph_region_lookup(spark, sf):
    return P.factors_of_region(I.graph(spark, sf), "FR", limit=10)


@query(
    "graph_industry_xref",
    "SELECT ef_id, ef_value, region AS region_code, entity_type FROM g_facts WHERE entity_type = 'sector' AND region = 'USA'",
)
def graph_industry_xref(spark, sf):
    return P.industry_reference(I.graph(spark, sf), "sector", "USA")


@query(
    "graph_assemble",
    """SELECT region, entity_type, source_dataset, count(*) AS rows FROM g_facts GROUP BY 1, 2, 3""",
)
def graph_assemble(spark, sf):
    """The star rebuilt from separate node and edge tables."""
    g = I.graph(spark, sf)
    parts = g.tables()
    rebuilt = G.FactorGraph.assemble(
        parts["emission_factors"],
        parts["ef_to_region"],
        parts["ef_to_entity_type"],
        parts["ef_to_source"],
        g.regions,
        g.types,
        g.sources,
        g.hierarchy,
    )
    return rebuilt.facts.groupBy("region", "entity_type", "source_dataset").agg(F.count(F.lit(1)).alias("rows"))


_MAPPING_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in C.REGION_MAPPING)


@query(
    "lit_region_mapping",
    f"""SELECT region_code, region_name, continent, economic_group, count(*) AS rows FROM (
  SELECT {I.country_sql("upper(trim(country))", "exact")} AS code FROM raw_product_region)
JOIN (VALUES {_MAPPING_VALUES}) v(region_code, region_name, continent, economic_group) ON code = region_code GROUP BY 1, 2, 3, 4""",
)
def lit_region_mapping(spark, sf):
    """The fixed region table joined to the countries of the customers."""
    from factorloom.functions.regions import standardize_country

    mapping = spark.createDataFrame(
        C.REGION_MAPPING, "region_code string, region_name string, continent string, economic_group string"
    )
    counts = (
        I.raw_product_region(spark, sf)
        .groupBy(standardize_country("Country", "exact").alias("region_code"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return counts.join(mapping, "region_code").select(*mapping.columns, "rows")


@query(
    "graph_hierarchy_nations",
    """SELECT r_name AS parent, count(DISTINCT n_nationkey) AS children, count(*) AS rows, round(avg(c_acctbal), 6) AS avg_value
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""",
)
def graph_hierarchy_nations(spark, sf):
    """Part-of over a hierarchy table given as data: customers below nations below regions."""
    nations = table(spark, sf, "nation")
    hierarchy = nations.join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("parent")
    )
    per_nation = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("total"))
    )
    return (
        per_nation.join(hierarchy, "c_nationkey")
        .groupBy("parent")
        .agg(
            F.count(F.lit(1)).alias("children"),
            F.sum("n").alias("rows"),
            F.round(F.sum("total") / F.sum("n"), 6).alias("avg_value"),
        )
    )


# regions, continents and the globe: the fixed rows, and every region of the facts that they leave out below the globe
_LEVELS = """SELECT child_region_code AS child, parent_region_code AS parent FROM g_hierarchy
  UNION SELECT region, 'GLB' FROM g_facts WHERE region IS NOT NULL AND region <> 'GLB' AND region NOT IN (SELECT child_region_code FROM g_hierarchy)
  UNION SELECT parent_region_code, 'GLB' FROM g_hierarchy WHERE parent_region_code <> 'GLB'"""
_CLOSURE = f"""levels AS ({_LEVELS}), below AS (
  SELECT parent AS ancestor, child AS region, 1 AS depth FROM levels
  UNION ALL SELECT b.ancestor, l.child, b.depth + 1 FROM below b JOIN levels l ON l.parent = b.region)"""


def _levelled(spark, sf):
    """The graph with a hierarchy of several levels."""
    g = I.graph(spark, sf)
    fixed = g.hierarchy.select("child_region_code", "parent_region_code")
    known = fixed.select(F.col("child_region_code").alias("region"))
    others = g.facts.where("region is not null and region <> 'GLB'").select("region").distinct().join(known, "region", "left_anti")
    parents = fixed.where("parent_region_code <> 'GLB'").select(F.col("parent_region_code").alias("region")).distinct()
    top = others.unionByName(parents).select(F.col("region").alias("child_region_code"), F.lit("GLB").alias("parent_region_code"))
    levels = fixed.unionByName(top).distinct().withColumn("relationship_type", F.lit("PART_OF"))
    return FactorGraph(g.facts, hierarchy=levels)


@query(
    "graph_part_of_closure",
    f"""WITH RECURSIVE {_CLOSURE}, sums AS (
  SELECT region, count(*) AS rows, count(ef_value) AS n, sum(ef_value) AS s, min(ef_value) AS lo, max(ef_value) AS hi FROM g_facts WHERE region IS NOT NULL GROUP BY 1)
SELECT ancestor AS region_code, sum(rows)::BIGINT AS rows, count(*) AS regions, round(sum(s) / sum(n), 6) AS avg_value, min(lo) AS least_value, max(hi) AS most_value
FROM (SELECT DISTINCT ancestor, region FROM below UNION SELECT region, region FROM sums) JOIN sums USING (region) GROUP BY 1""",
)
def graph_part_of_closure(spark, sf):
    """Facts rolled up over countries, continents and the globe."""
    return P.rollup_all_levels(_levelled(spark, sf)).withColumn("avg_value", F.round("avg_value", 6))


@query(
    "graph_part_of_levels",
    f"""WITH RECURSIVE {_CLOSURE}
SELECT ef_id, entity_name, ef_value, ef_unit, r.name AS country, depth FROM g_facts f
JOIN (SELECT region, min(depth) AS depth FROM below WHERE ancestor = 'GLB' GROUP BY 1) b ON b.region = f.region
JOIN g_regions r ON r.region_code = f.region""",
)
def graph_part_of_levels(spark, sf):
    """Every fact below the globe, with its distance from it."""
    return P.part_of_all_levels(_levelled(spark, sf), "GLB")
