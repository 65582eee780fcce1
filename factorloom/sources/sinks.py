"""Writers: delimited text with checksums, JSON and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.operators.profile import metadata_profile, summary_lines
from factorloom.operators.sampling import split_share
from factorloom.schema import as_of_date
from factorloom.sources.readers import file_name


def flatten_for_text(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, which delimited files cannot hold otherwise."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


#: White space at the ends of a value and line breaks inside are kept.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def checksums(spark, path: str) -> DataFrame:
    """MD5 of every data file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(file_name("path").alias("file_name"), F.md5("content").alias("md5"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV plus a ``.md5`` side table with one checksum per part file.

    A checksum reads a file whole, so part files are kept below ``PART_ROWS`` rows.
    """
    flatten_for_text(df).write.mode("overwrite").options(**CSV_OPTIONS, maxRecordsPerFile=PART_ROWS).csv(path)
    lines = checksums(df.sparkSession, path).select(F.concat_ws("  ", "md5", "file_name").alias("value"))
    lines.write.mode("overwrite").text(f"{path}.md5")


def write_parquet(df: DataFrame, path: str, partition_by: str = "source_dataset") -> None:
    """Columnar copy, partitioned so that source filters skip whole folders."""
    df.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Some 25 MB of merged rows: each core of a machine holds one file.
PART_ROWS = 100_000

PROCESSING_STEPS = [
    "loaded and shaped every source",
    "linked entities across sources",
    "numbered the rows",
    "flagged outliers",
    "standardised units",
    "applied regional multipliers",
]


def about(
    df: DataFrame, title: str, description: str, version: str, as_of: str | None = None, steps: list[str] | None = None
) -> DataFrame:
    """One row that describes a merged table: texts, date, columns, sources, counts, confidence range and steps."""
    text = lambda x: F.lit(x).cast("string")
    counted = df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sort_array(F.collect_set("source_dataset")).alias("source_datasets"),
        F.count_distinct("region").alias("regions"),
        F.array(F.coalesce(F.min("confidence"), F.lit(0.0)), F.coalesce(F.max("confidence"), F.lit(0.0))).alias("confidence_range"),
    )
    return counted.select(
        text(title).alias("title"),
        text(description).alias("description"),
        text(version).alias("version"),
        as_of_date(as_of).alias("created_at"),
        "source_datasets",
        "record_count",
        F.array(*(text(c) for c in df.columns)).alias("columns"),
        "regions",
        "confidence_range",
        F.array(*(text(x) for x in (steps if steps is not None else PROCESSING_STEPS))).alias("processing_steps"),
    )


def write_metadata(
    df: DataFrame,
    path: str,
    title: str = "Harmonised factors",
    description: str = "Factors of all sources in one schema",
    version: str = "1.0",
    as_of: str | None = None,
) -> None:
    """Dataset metadata as JSON: ``about`` has one object, ``counts`` lines of (section, item, value)."""
    write_json(about(df, title, description, version, as_of), f"{path}/about")
    write_json(metadata_profile(df), f"{path}/counts")


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Header CSV of every table of a graph export, one folder each."""
    for name, df in tables.items():
        flatten_for_text(df).write.mode("overwrite").options(**CSV_OPTIONS).csv(f"{path}/{name}")


def write_summary(df: DataFrame, path: str) -> None:
    """Text report in reading order; sorted ranges become consecutive part files."""
    ordered = summary_lines(df).orderBy("part", "place", "line")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_instruction_set(df: DataFrame, path: str, key: list[str], share: float = 0.8, seed: int = 42) -> None:
    """Full, training and validation files."""
    write_json(df, path)
    train, validation = split_share(df, share, key, seed)
    write_json(train, f"{path}_train")
    write_json(validation, f"{path}_val")


def report_lines(metrics: DataFrame, examples: DataFrame, count: int = 5) -> DataFrame:
    """Evaluation report as rows (place, line): metric table, then the first examples.

    ``examples`` needs ``id`` and the scored texts; only ``count`` rows are used.
    """
    names = [c for c in metrics.columns if c in ("mape", "source_attribution_accuracy", "hallucination_rate")]
    entries = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("metric"), F.col(c).alias("score")) for i, c in enumerate(names)]
    table = metrics.select(F.inline(F.array(*entries))).where("score is not null").select(
        F.col("place").cast("bigint").alias("place"),
        F.format_string("| %s | %.2f |", F.col("metric"), F.col("score")).alias("line"),
    )
    first = examples.orderBy("id").limit(count)
    shown: list[Column] = [
        F.concat(F.lit("**Instruction**: "), "instruction"),
        F.when(F.col("input") != "", F.concat(F.lit("**Input**: "), "input")),
        F.concat(F.lit("**Expected Output**: "), "expected_output"),
        F.concat(F.lit("**Model Output**: "), "model_output"),
    ]
    body = first.select(F.col("id"), F.posexplode(F.array(*shown)).alias("part", "line")).where("line is not null")
    return table.unionByName(body.select((F.col("id") * 10 + F.col("part") + 100).alias("place"), "line"))
