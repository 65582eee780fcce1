"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import VALID_RECORD_FIELDS
from factorloom.functions.bands import reliability_band
from factorloom.functions.numbers import percent_error
from factorloom.functions.text import simplify_name
from factorloom.operators.sampling import mark_share


def record_is_valid(columns: list[str] | None = None) -> Column:
    """True when every required field is present."""
    valid = F.lit(True)
    for c in columns or VALID_RECORD_FIELDS:
        valid = valid & F.col(c).isNotNull()
    return valid


def completeness(df: DataFrame, columns: list[str], target: float = 0.95) -> DataFrame:
    """Share of non-null values per column and whether it is above the target."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns]
    return shares.select(F.inline(F.array(*entries))).withColumn("meets_target", F.col("share") > target)


def consistency(df: DataFrame, limit: float = 0.2) -> DataFrame:
    """Entities whose mean value differs between sources by more than ``limit``.

    Rows are averaged per (name, source) and the extremes compared; pairs of
    rows are never formed.
    """
    means = (
        df.withColumn("name", simplify_name("entity_name"))
        .dropna(subset=["name", "ef_value"])
        .groupBy("name", "source_dataset")
        .agg(F.avg("ef_value").alias("_mean"))
    )
    ranges = means.groupBy("name").agg(
        F.count(F.lit(1)).alias("sources"), F.min("_mean").alias("low"), F.max("_mean").alias("high")
    )
    spread = F.try_divide(F.col("high") - F.col("low"), F.abs("low"))
    return ranges.withColumn("spread", spread).where((F.col("sources") > 1) & (F.col("spread") > limit))


def timeliness(df: DataFrame, as_of: Column, years: int = 3) -> DataFrame:
    """Rows per source older than ``years`` at ``as_of``."""
    stale = F.col("timestamp").cast("date") < F.add_months(as_of.cast("date"), -12 * years)
    return df.groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(stale).alias("stale_rows")
    )


def confidence_bands(df: DataFrame) -> DataFrame:
    return df.groupBy(reliability_band("confidence").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


def audit_sample(df: DataFrame, share: float, strata: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``ceil(share * n)`` rows of every stratum, reproducible by hash."""
    marked = mark_share(df, share, key, by=strata, seed=seed, out="_in", rounding="ceil")
    return marked.where("_in").drop("_in")


def mape_against(df: DataFrame, reference_source: str) -> DataFrame:
    """Mean absolute percentage error of each source's entity means against one source."""
    means = (
        df.withColumn("name", simplify_name("entity_name"))
        .dropna(subset=["name", "ef_value"])
        .groupBy("name", "source_dataset")
        .agg(F.avg("ef_value").alias("_mean"))
    )
    truth = means.where(F.col("source_dataset") == reference_source).select("name", F.col("_mean").alias("_truth"))
    others = means.where(F.col("source_dataset") != reference_source)
    return (
        others.join(truth, "name")
        .groupBy("source_dataset")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.avg(percent_error(F.col("_mean"), F.col("_truth"))).alias("mape"),
        )
    )
