"""Ordered value bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.constants import CONFIDENCE_BANDS, VALUE_BAND_LAST, VALUE_BANDS
from factorloom.functions.text import col


def value_band(c: Column | str) -> Column:
    """Five bands; a missing value falls through to the last one."""
    result = None
    for upper, label in VALUE_BANDS:
        test = col(c) < upper
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return result.otherwise(F.lit(VALUE_BAND_LAST))


def confidence_band(c: Column | str, scale: float = 1.0) -> Column:
    """low / medium / high on 0-100; pass ``scale=100`` for 0-1 confidences.

    Values outside every band, 100 itself included, read as low.
    """
    scaled = col(c) * scale
    result = None
    for lower, upper, label in CONFIDENCE_BANDS:
        test = (scaled >= lower) & (scaled < upper)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return result.otherwise(F.lit("low"))


def reliability_band(c: Column | str) -> Column:
    """Confidence classes of the published quality table."""
    return (
        F.when(col(c) > 0.7, F.lit("high"))
        .when(col(c) >= 0.6, F.lit("medium"))
        .when(col(c).isNotNull(), F.lit("low"))
        .otherwise(F.lit("unknown"))
    )
