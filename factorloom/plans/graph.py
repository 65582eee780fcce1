"""Node and edge tables of the factor graph.

A fact carries its region, type and source as columns, so edges are
projections of the fact table and patterns are filters, groupings and joins of
small results with the node tables. No edge list has to be joined back to facts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.constants import BASE_UNIT, GRAPH_SOURCE_URL_PREFIX, REGION_HIERARCHY
from factorloom.functions.numbers import coerce_numeric, flag_column
from factorloom.functions.regions import graph_region_continent, graph_region_name
from factorloom.functions.text import slug, source_version
from factorloom.operators.ordering import first_seen_ordinals
from factorloom.operators.sizing import sized_broadcast
from factorloom.schema import as_of_date, by_length
from factorloom.session import cut_lineage


def fact_nodes(df: DataFrame, key: str = "id", as_of: str | None = None) -> DataFrame:
    """Fact rows with a reproducible id, defaults filled in and flags as booleans.

    ``region``, ``entity_type`` and ``source_dataset`` stay on the row: they are
    the ends of its three edges.
    """
    return df.select(
        F.concat(F.lit("ef_"), F.md5(F.col(key).cast("string"))).alias("ef_id"),
        F.coalesce("entity_id", F.lit("")).alias("entity_id"),
        F.coalesce("entity_name", F.lit("")).alias("entity_name"),
        F.coalesce("ef_value", F.lit(0.0)).alias("ef_value"),
        F.coalesce("ef_unit", F.lit(BASE_UNIT)).alias("ef_unit"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        flag_column(df, "is_outlier").alias("is_outlier"),
        flag_column(df, "multiplier_applied").alias("multiplier_applied"),
        F.coalesce("timestamp", as_of_date(as_of)).alias("timestamp"),
        "region",
        "entity_type",
        "source_dataset",
        by_length(key).alias("_ord"),
    )


def load_typed(df: DataFrame) -> DataFrame:
    """Text node rows to typed ones: numbers parsed, flags true only for ``True``."""
    return df.withColumns(
        {
            "ef_value": coerce_numeric("ef_value"),
            "confidence": coerce_numeric("confidence"),
            "is_outlier": F.coalesce(F.col("is_outlier") == "True", F.lit(False)),
            "multiplier_applied": F.coalesce(F.col("multiplier_applied") == "True", F.lit(False)),
        }
    )


def region_nodes(facts: DataFrame) -> DataFrame:
    codes = facts.select(F.col("region").alias("region_code")).where("region_code is not null").distinct()
    return codes.select(
        "region_code",
        graph_region_name("region_code").alias("name"),
        graph_region_continent("region_code").alias("continent"),
        (F.col("region_code") == "GLB").alias("is_global"),
    )


def type_nodes(facts: DataFrame) -> DataFrame:
    numbered = first_seen_ordinals(facts, "entity_type")
    return numbered.select(
        F.concat(F.lit("type_"), F.col("_n").cast("string")).alias("type_id"),
        F.col("entity_type").alias("type_name"),
        F.concat(F.lit("Emission factors for "), "entity_type").alias("description"),
    )


def source_nodes(facts: DataFrame) -> DataFrame:
    numbered = first_seen_ordinals(facts, "source_dataset")
    return numbered.select(
        F.concat(F.lit("source_"), F.col("_n").cast("string")).alias("source_id"),
        F.col("source_dataset").alias("name"),
        source_version("source_dataset").alias("version"),
        F.concat(F.lit(GRAPH_SOURCE_URL_PREFIX), slug("source_dataset")).alias("url"),
    )


def region_hierarchy(spark: SparkSession) -> DataFrame:
    """The eight fixed part-of rows; pass a table of the same columns for more."""
    return spark.createDataFrame(
        REGION_HIERARCHY, "child_region_code string, parent_region_code string, relationship_type string"
    )


class FactorGraph:
    """Facts with their node tables and the region hierarchy.

    Node tables are distinct values of the facts; each is computed and
    checkpointed once, when a pattern first needs it.
    """

    def __init__(
        self,
        facts: DataFrame,
        regions: DataFrame | None = None,
        types: DataFrame | None = None,
        sources: DataFrame | None = None,
        hierarchy: DataFrame | None = None,
    ) -> None:
        self.facts = facts
        self.hierarchy = hierarchy if hierarchy is not None else region_hierarchy(facts.sparkSession)
        self._given = {"regions": regions, "types": types, "sources": sources}

    @classmethod
    def build(cls, merged: DataFrame, key: str = "id", hierarchy: DataFrame | None = None) -> FactorGraph:
        return cls(fact_nodes(merged, key), hierarchy=hierarchy)

    @cached_property
    def regions(self) -> DataFrame:
        given = self._given["regions"]
        return given if given is not None else cut_lineage(region_nodes(self.facts))

    @cached_property
    def types(self) -> DataFrame:
        given = self._given["types"]
        return given if given is not None else cut_lineage(type_nodes(self.facts))

    @cached_property
    def sources(self) -> DataFrame:
        given = self._given["sources"]
        return given if given is not None else cut_lineage(source_nodes(self.facts))

    @classmethod
    def assemble(
        cls,
        nodes: DataFrame,
        to_region: DataFrame,
        to_type: DataFrame,
        to_source: DataFrame,
        regions: DataFrame,
        types: DataFrame,
        sources: DataFrame,
        hierarchy: DataFrame,
    ) -> FactorGraph:
        """From separate node and edge tables, joined on the fact key once."""
        kinds = types.select("type_id", F.col("type_name").alias("entity_type"))
        labels = sources.select("source_id", F.col("name").alias("source_dataset"))
        facts = (
            nodes.join(to_region.select("ef_id", F.col("region_code").alias("region")), "ef_id", "left")
            .join(to_type.select("ef_id", "type_id").join(sized_broadcast(kinds), "type_id"), "ef_id", "left")
            .join(to_source.select("ef_id", "source_id").join(sized_broadcast(labels), "source_id"), "ef_id", "left")
            .drop("type_id", "source_id")
        )
        return cls(facts, regions, types, sources, hierarchy)

    def edges_to_region(self) -> DataFrame:
        return self.facts.select("ef_id", F.col("region").alias("region_code"), "confidence")

    def edges_to_type(self) -> DataFrame:
        names = self.types.select(F.col("type_name").alias("entity_type"), "type_id")
        return self.facts.join(sized_broadcast(names, computed=True), "entity_type", "left").select(
            "ef_id", F.coalesce("type_id", F.lit("")).alias("type_id"), "confidence"
        )

    def edges_to_source(self) -> DataFrame:
        names = self.sources.select(F.col("name").alias("source_dataset"), "source_id")
        return self.facts.join(sized_broadcast(names, computed=True), "source_dataset", "left").select(
            "ef_id", F.coalesce("source_id", F.lit("")).alias("source_id"), "timestamp"
        )

    def tables(self) -> dict[str, DataFrame]:
        """The eight tables of a graph export."""
        return {
            "regions": self.regions,
            "entity_types": self.types,
            "sources": self.sources,
            "emission_factors": self.facts.drop("region", "entity_type", "source_dataset", "_ord"),
            "ef_to_region": self.edges_to_region(),
            "ef_to_entity_type": self.edges_to_type(),
            "ef_to_source": self.edges_to_source(),
            "region_hierarchy": self.hierarchy,
        }

    def table_counts(self) -> DataFrame:
        """``name, rows`` of the eight tables.

        Every fact has one edge of each kind, as node names are unique, so one count of the facts serves four tables.
        """
        per_fact = ["emission_factors", "ef_to_region", "ef_to_entity_type", "ef_to_source"]
        names = F.explode(F.array(*map(F.lit, per_fact))).alias("name")
        counts = self.facts.agg(F.count(F.lit(1)).alias("rows")).select(names, "rows")
        others = {"regions": self.regions, "entity_types": self.types, "sources": self.sources, "region_hierarchy": self.hierarchy}
        for name, df in others.items():
            counts = counts.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows"))
        return counts


def key_check(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Uniqueness of node keys: (label, rows, distinct keys, unique)."""
    result = None
    for label, df, key in tables:
        per_key = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
        part = per_key.agg(
            F.coalesce(F.sum("_c"), F.lit(0)).alias("rows"), F.count("_k").alias("distinct_keys")
        ).select(F.lit(label).alias("label"), "rows", "distinct_keys")
        result = part if result is None else result.unionByName(part)
    return result.withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def edge_integrity(edges: DataFrame, start: DataFrame, end: DataFrame, start_key: str, end_key: str) -> DataFrame:
    """Edges with both ends present, and those left dangling, in one row.

    Ends are checked by semi joins; the small end table is broadcast once counted.
    """
    ends = sized_broadcast(end.select(end_key).distinct()).withColumn("_end", F.lit(True))
    starts = start.select(start_key).distinct().withColumn("_start", F.lit(True))
    checked = edges.join(ends, end_key, "left").join(starts, start_key, "left")
    whole = F.col("_end").isNotNull() & F.col("_start").isNotNull()
    return checked.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(whole).alias("loaded"), F.count_if(~whole).alias("dangling")
    )


def existing(column: Column | str) -> Column:
    """An edge end matches only if it is not null."""
    return (F.col(column) if isinstance(column, str) else column).isNotNull()
