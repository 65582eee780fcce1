"""Scoring model answers against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.numbers import percent_error
from factorloom.functions.responses import extract_source, extract_value
from factorloom.functions.tags import empty_tags


def score_rows(answers: DataFrame, references: DataFrame, mode: str = "exact") -> DataFrame:
    """One scored row per example id.

    ``answers``: ``id``, ``model_output``. ``references``: ``id``,
    ``instruction``, ``input``, ``output``, ``sources``.

    A cited source is a hallucination when the reference does not list it.
    ``reference`` compares it as written with the lower-cased list, so any
    capital letter counts against it; ``exact`` lower-cases both.
    """
    if mode not in ("exact", "reference"):
        raise ValueError(f"unknown scoring mode: {mode}")
    joined = references.join(answers, "id").select(
        "id",
        "instruction",
        "input",
        F.col("output").alias("expected_output"),
        "model_output",
        extract_value("model_output").alias("answer_value"),
        extract_value("output").alias("expected_value"),
        extract_source("model_output").alias("answer_source"),
        extract_source("output").alias("expected_source"),
        F.transform(F.coalesce("sources", empty_tags()), lambda s: F.lower(s)).alias("_listed"),
    )
    cited = F.col("answer_source") if mode == "reference" else F.lower("answer_source")
    both = F.col("answer_source").isNotNull() & F.col("expected_source").isNotNull()
    return joined.select(
        *[c for c in joined.columns if c != "_listed"],
        percent_error(F.col("answer_value"), F.col("expected_value")).alias("value_error"),
        F.when(both, F.lower("answer_source") == F.lower("expected_source")).alias("source_match"),
        F.when(both, ~F.array_contains("_listed", cited)).alias("hallucinated"),
    )


def metrics(scored: DataFrame) -> DataFrame:
    """One row; a metric without any scorable example is null."""
    share = {
        "source_attribution_accuracy": F.avg(F.col("source_match").cast("double")) * 100,
        "hallucination_rate": F.avg(F.col("hallucinated").cast("double")) * 100,
    }
    return scored.agg(
        F.avg("value_error").alias("mape"), *[expression.alias(name) for name, expression in share.items()]
    )


def precision_at(ranked: DataFrame, truth: DataFrame, k: int = 3) -> DataFrame:
    """Percentage of queries whose true item is among their first ``k`` answers.

    ``ranked``: ``query``, ``rank``, ``item``. ``truth``: ``query``, ``item``.
    """
    hits = (
        truth.withColumnRenamed("item", "_truth")
        .join(ranked.where(F.col("rank") <= k), "query", "left")
        .groupBy("query")
        .agg(F.max(F.coalesce(F.col("item") == F.col("_truth"), F.lit(False)).cast("double")).alias("_hit"))
    )
    return hits.agg(F.count(F.lit(1)).alias("queries"), (F.avg("_hit") * 100).alias("precision"))
