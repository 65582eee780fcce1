"""Counts, histograms, summary lines and table fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import SUMMARY_MIN_REGION_COUNT


def value_counts(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), column)
    )


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return value_counts(df, column).limit(n)


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one scan: (section, item, rows)."""
    pairs = [F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("item")) for c in columns]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where("item is not null")
        .groupBy("section", "item")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def totals(df: DataFrame) -> DataFrame:
    """Record count and confidence range of a merged table; an all-null range is 0 to 0."""
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence_min"),
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence_max"),
        F.avg("confidence").alias("confidence_mean"),
    )


def metadata_profile(df: DataFrame) -> DataFrame:
    """Dataset metadata as rows (section, item, value).

    Long form: histograms of any length stay distributed instead of being
    packed into one map.
    """
    counts = histograms(df, ["entity_type", "ef_unit", "region", "source_dataset"])
    listed = counts.where(F.col("section").isin("entity_type", "ef_unit")).select(
        "section", "item", F.col("rows").cast("double").alias("value")
    )
    distinct = counts.groupBy("section").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("distinct").alias("section"), F.col("section").alias("item"), "value"
    )
    overall = totals(df).select(
        F.inline(
            F.array(
                _entry("total", "record_count"),
                _entry("confidence", "confidence_min"),
                _entry("confidence", "confidence_max"),
            )
        )
    )
    return overall.unionByName(distinct).unionByName(listed)


def _entry(section: str, column: str) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(column).alias("item"),
        F.col(column).cast("double").alias("value"),
    )


def dataset_profiles(datasets: dict[str, DataFrame]) -> DataFrame:
    """Older form, per dataset: rows, columns, distinct regions and the type histogram."""
    result = None
    for name, df in datasets.items():
        label = F.lit(name).alias("dataset")
        counts = histograms(df, [c for c in ("region", "entity_type") if c in df.columns])
        size = df.agg(F.count(F.lit(1)).cast("bigint").alias("value")).select(
            label, F.lit("rows").alias("section"), F.lit("").alias("item"), "value"
        )
        shown = [c for c in df.columns if not c.startswith("_")]
        columns = size.select(
            "dataset",
            F.lit("columns").alias("section"),
            F.lit(",".join(shown)).alias("item"),
            F.lit(len(shown)).cast("bigint").alias("value"),
        )
        regions = counts.where("section = 'region'").agg(F.count(F.lit(1)).alias("value")).select(
            label, F.lit("regions").alias("section"), F.lit("").alias("item"), "value"
        )
        types = counts.where("section = 'entity_type'").select(
            label, "section", "item", F.col("rows").alias("value")
        )
        part = size.unionByName(columns).unionByName(regions).unionByName(types)
        result = part if result is None else result.unionByName(part)
    return result


def summary_lines(df: DataFrame) -> DataFrame:
    """Text report as rows (part, place, line) in reading order.

    Regions are listed when they have more than ten rows.
    """
    counts = histograms(df, ["entity_type", "source_dataset", "region"])
    sizes = counts.groupBy().agg(
        F.count_if(F.col("section") == "source_dataset").alias("sources"),
        F.count_if(F.col("section") == "region").alias("regions"),
    )
    mean = F.format_string("%.2f", F.round("confidence_mean", 2))
    head = totals(df).select(
        F.inline(
            F.array(
                _line(0, 1, F.concat(F.lit("Total records: "), F.col("record_count").cast("string"))),
                _line(0, 4, F.concat(F.lit("Average confidence score: "), mean)),
            )
        )
    ).unionByName(
        sizes.select(
            F.inline(
                F.array(
                    _line(0, 2, F.concat(F.lit("Datasets included: "), F.col("sources").cast("string"))),
                    _line(0, 3, F.concat(F.lit("Regions covered: "), F.col("regions").cast("string"))),
                )
            )
        )
    )
    part = (
        F.when(F.col("section") == "entity_type", 1).when(F.col("section") == "source_dataset", 2).otherwise(3)
    )
    listed = counts.where((F.col("section") != "region") | (F.col("rows") > SUMMARY_MIN_REGION_COUNT)).select(
        part.alias("part"),
        (-F.col("rows")).alias("place"),
        F.concat(F.lit("- "), F.col("item"), F.lit(": "), F.col("rows").cast("string")).alias("line"),
    )
    return head.unionByName(listed)


def _line(part: int, place: int, text: Column) -> Column:
    return F.struct(
        F.lit(part).alias("part"), F.lit(place).cast("bigint").alias("place"), text.alias("line")
    )


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-insensitive checksum of a table: rows and the sums of two parts of each row's MD5.

    A row's text is its columns joined by ``|``, a null as ``\\N``.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in (columns or df.columns)))
    part = lambda start: F.conv(F.substring(F.col("_md5"), start, 8), 16, 10).cast("bigint")
    return df.select(F.md5(text).alias("_md5")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(part(1)), F.lit(0)).alias("first_sum"),
        F.coalesce(F.sum(part(9)), F.lit(0)).alias("second_sum"),
    )


def flag_totals(df: DataFrame, by: str | None = None) -> DataFrame:
    """Rows, outliers and multiplier hits, overall or per column value."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("is_outlier")).alias("outliers"),
        F.count_if(F.col("multiplier_applied")).alias("multipliers"),
    )
