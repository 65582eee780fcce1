"""Outlier flags from the z-score and the interquartile range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import OUTLIER_IQR_FACTOR, OUTLIER_MIN_VALUES, OUTLIER_Z
from factorloom.functions.numbers import null_nan
from factorloom.operators.quantiles import approximate_statistics, exact_statistics
from factorloom.operators.sizing import sized_broadcast

_STATS = ["n", "mean", "std", "q"]


def _flag(value: Column, n: Column, mean: Column, std: Column, q1: Column, q3: Column, z: float) -> Column:
    spread = q3 - q1
    # no spread gives a null score and an infinite value in the group gives NaN ones, which are above any
    # number here; neither flags. The infinite value itself lies outside the quartile fences.
    score = F.abs(F.try_divide(value - mean, std))
    far = F.coalesce((score > z) & ~F.isnan(score), F.lit(False))
    outside = (spread > 0) & ~F.isnan(spread) & (
        (value < q1 - OUTLIER_IQR_FACTOR * spread) | (value > q3 + OUTLIER_IQR_FACTOR * spread)
    )
    return F.coalesce((n >= OUTLIER_MIN_VALUES) & (far | outside), F.lit(False))


def group_statistics(df: DataFrame, value: str, by: list[str] | None = None, method: str = "exact") -> DataFrame:
    if method == "exact":
        return exact_statistics(df, value, [0.25, 0.75], by)
    if method == "approx":
        return approximate_statistics(df, value, [0.25, 0.75], by)
    raise ValueError(f"unknown quantile method: {method}")


def flag_outliers(
    df: DataFrame,
    value: str = "ef_value",
    by: list[str] | None = None,
    z: float = OUTLIER_Z,
    out: str = "is_outlier",
    method: str = "exact",
    keep_true: bool = False,
    statistics: DataFrame | None = None,
) -> DataFrame:
    """Flag values far from the mean or outside the quartile fences.

    Without ``by`` the one row of statistics is folded into the plan as
    literals. With ``by`` the statistics table is joined on, broadcast only
    after it has been counted. Groups with fewer than ten values, null values
    and null groups are never flagged. ``keep_true`` leaves flags already set.

    ``df`` is read for the statistics and again for the flags: stage it first
    when it is costly, or pass ``statistics`` of a cheaper table with the same
    values.
    """
    stats = statistics if statistics is not None else group_statistics(df, value, by, method)
    v = null_nan(F.col(value).cast("double"))
    if not by:
        row = stats.head()
        if row is None:
            flag = F.lit(False)
        else:
            flag = _flag(v, F.lit(row.n), F.lit(row.mean), F.lit(row["std"]), F.lit(row.q[0]), F.lit(row.q[1]), z)
        joined = df
    else:
        named = stats.select(*by, *[F.col(c).alias(f"_{c}") for c in _STATS])
        joined = df.join(sized_broadcast(named), by, "left")
        flag = _flag(v, F.col("_n"), F.col("_mean"), F.col("_std"), F.col("_q")[0], F.col("_q")[1], z)
    if keep_true:
        flag = F.when(flag, F.lit(True)).otherwise(F.col(out))
    return joined.withColumn(out, flag).select(*df.columns, *([out] if out not in df.columns else []))
