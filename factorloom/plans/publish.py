"""The whole run: sources to data, crosswalk, metadata, report and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.plans.graph import FactorGraph
from factorloom.plans.harmonize import Options, canonical_union, entity_crosswalk, harmonize
from factorloom.plans.snapshots import Published, Writing, load_interim
from factorloom.session import stage
from factorloom.sources import sinks
from factorloom.sources.registry import Registry


def publish(datasets: dict[str, DataFrame], out: str, options: Options = Options(), as_of: str | None = None) -> DataFrame:
    """Harmonise canonical datasets and write everything below ``out``; the merged table comes back.

    ``data`` (CSV with checksums), ``crosswalk``, ``metadata``, ``summary`` and the
    eight tables of ``graph``.
    """
    written = canonical_union(datasets)
    merged = stage(harmonize(datasets, options, written), "merged")
    sinks.write_csv(merged, f"{out}/data")
    sinks.write_csv(entity_crosswalk(datasets, options, written), f"{out}/crosswalk")
    sinks.write_metadata(merged, f"{out}/metadata", as_of=as_of)
    sinks.write_summary(merged, f"{out}/summary")
    sinks.write_graph(FactorGraph.build(merged).tables(), f"{out}/graph")
    return merged


def publish_set(
    writing: Writing, datasets: dict[str, DataFrame], options: Options = Options(), as_of: str | None = None
) -> int:
    """The same parts as :func:`publish`, put in force together by the manifest; the set's number comes back.

    ``merged`` holds the merged rows as parquet besides.
    """
    spark = writing.spark
    shaped = canonical_union(datasets)
    harmonize(datasets, options, shaped).write.mode("errorifexists").parquet(writing.path("merged"))
    merged = spark.read.parquet(writing.path("merged"))
    known = writing.add("merged", "parquet", merged, lambda path: None)
    writing.add("data", "csv", merged, lambda path: sinks.write_csv(merged, path), known=known)
    pairs = stage(entity_crosswalk(datasets, options, shaped), "crosswalk")
    writing.add("crosswalk", "csv", pairs, lambda path: sinks.write_csv(pairs, path))
    sinks.write_metadata(merged, writing.path("metadata"), as_of=as_of)
    for name in ("about", "counts"):
        written = spark.read.json(writing.path(f"metadata/{name}"))
        writing.add(f"metadata/{name}", "json", written, lambda path: None)
    sinks.write_summary(merged, writing.path("summary"))
    writing.add("summary", "text", spark.read.text(writing.path("summary")), lambda path: None)
    graph = FactorGraph.build(merged).tables()
    sinks.write_graph(graph, writing.path("graph"))
    for name, table in graph.items():
        writing.add(f"graph/{name}", "csv", table, lambda path: None)
    return writing.commit()


def run_set(
    spark: SparkSession,
    registry: Registry,
    paths: dict[str, str],
    out: str,
    options: Options = Options(),
    as_of: str | None = None,
) -> int:
    """Load every registered source that has a path, shaping only those that changed, then publish one set."""
    writing = Published(spark, out).begin()
    return publish_set(writing, load_interim(spark, registry, paths, writing, as_of), options, as_of)


def run(
    spark: SparkSession,
    registry: Registry,
    paths: dict[str, str],
    out: str,
    options: Options = Options(),
    as_of: str | None = None,
) -> DataFrame:
    """Load every registered source that has a path, then publish."""
    return publish(registry.load_all(spark, paths, as_of), out, options, as_of)
