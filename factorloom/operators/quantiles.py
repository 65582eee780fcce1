"""Exact quantiles by interval narrowing.

``percentile`` holds every distinct value of a group in one task. Here each
pass only counts values per bucket: first by magnitude (sixteen buckets per
power of two), then by equal steps inside the buckets that hold the wanted
ranks. The bucket functions never decrease with the value, so ranks stay exact.
A slice shrinks 65,536-fold per pass and three passes leave at most some tens
of thousands of distinct doubles in it, however the values are distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.numbers import null_nan
from factorloom.operators.sizing import sized_broadcast
from factorloom.session import cut_lineage

STEPS = 65_535
SLICE_ROWS = 1_000_000
MAX_PASSES = 3


def _magnitude_bucket(v: Column) -> Column:
    exponent = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-1100.0)), F.lit(1100.0))
    bucket = F.floor(exponent * 16).cast("bigint") + 20_000
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, bucket).otherwise(-bucket)


def _running(column: str, keys: list[str], order: str) -> Column:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(column).over(frame)


def exact_statistics(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per group: ``n``, ``mean``, ``std`` (population) and ``q`` (array).

    Null and NaN values are skipped, as are rows with a null group key.
    Quantiles interpolate linearly between neighbouring ranks.
    """
    groups = list(by or [])
    keys = [f"_g{i}" for i in range(len(groups))] or ["_g0"]
    grouping = [F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias("_g0")]
    rows = df.select(*grouping, null_nan(F.col(value).cast("double")).alias("_v")).dropna(subset=keys)
    rows = rows.withColumn("_b", _magnitude_bucket(F.col("_v")))

    group = Window.partitionBy(*keys)
    histogram = (
        rows.groupBy(*keys, "_b")
        .agg(
            F.count("_v").alias("_c"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.avg("_v").alias("_avg"),
            F.var_pop("_v").alias("_var"),
        )
        .where("_c > 0")
        .withColumn("n", F.sum("_c").over(group))
        .withColumn("mean", F.sum(F.col("_c") * F.col("_avg")).over(group) / F.col("n"))
        .withColumn(
            "std",
            F.sqrt(
                F.sum(F.col("_c") * (F.col("_var") + F.pow(F.col("_avg") - F.col("mean"), 2))).over(group)
                / F.col("n")
            ),
        )
        .withColumn("_before", _running("_c", keys, "_b") - F.col("_c"))
    )
    wanted = []
    for i, p in enumerate(probabilities):
        position = F.lit(float(p)) * (F.col("n") - 1)
        wanted.append(F.struct(F.lit(2 * i).alias("_t"), F.floor(position).alias("_r")))
        wanted.append(F.struct(F.lit(2 * i + 1).alias("_t"), F.ceil(position).alias("_r")))
    state = ["_b", "_lo", "_hi", "_c", "_before"]
    targets = (
        histogram.select(*keys, "n", "mean", "std", *state, F.inline(F.array(*wanted)))
        .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c")))
    )
    targets = cut_lineage(targets)

    for _ in range(MAX_PASSES - 1):
        widest = targets.where("_lo < _hi").agg(F.max("_c")).head()[0]
        if widest is None or widest <= slice_rows:
            break
        targets = cut_lineage(_narrow(rows, targets, keys))

    found = targets.where("_lo = _hi").withColumn("_x", F.col("_lo"))
    still_open = targets.where("_lo < _hi")
    if not still_open.isEmpty():
        found = found.unionByName(_resolve(rows, still_open, keys))

    picks = []
    for i, p in enumerate(probabilities):
        low = F.max(F.when(F.col("_t") == 2 * i, F.col("_x")))
        high = F.max(F.when(F.col("_t") == 2 * i + 1, F.col("_x")))
        position = F.lit(float(p)) * (F.max("n") - 1)
        picks.append(low + (high - low) * (position - F.floor(position)))
    result = found.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("std").alias("std"), F.array(*picks).alias("q")
    )
    return result.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], "n", "mean", "std", "q")


def _in_slices(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows inside the value ranges that still hold a wanted rank."""
    slices = targets.where("_lo < _hi").select(*keys, "_b", "_lo", "_hi").distinct()
    return rows.join(sized_broadcast(slices), [*keys, "_b"]).where("_v between _lo and _hi")


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    slice_keys = [*keys, "_b", "_lo", "_hi"]
    step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * STEPS)
    counts = (
        _in_slices(rows, targets, keys)
        .groupBy(*slice_keys, step.alias("_s"))
        .agg(F.count("_v").alias("_c2"), F.min("_v").alias("_lo2"), F.max("_v").alias("_hi2"))
        .withColumn("_before2", _running("_c2", slice_keys, "_s") - F.col("_c2"))
    )
    rank = F.col("_r") - F.col("_before")
    narrowed = (
        targets.where("_lo < _hi")
        .join(counts, slice_keys)
        .where((rank >= F.col("_before2")) & (rank < F.col("_before2") + F.col("_c2")))
        .select(
            *keys, "n", "mean", "std", "_b",
            F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), F.col("_c2").alias("_c"),
            (F.col("_before") + F.col("_before2")).alias("_before"), "_t", "_r",
        )
    )
    return targets.where("_lo = _hi").unionByName(narrowed)


def _resolve(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    slice_keys = [*keys, "_b", "_lo", "_hi"]
    counts = (
        _in_slices(rows, targets, keys)
        .groupBy(*slice_keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c2"))
        .withColumn("_before2", _running("_c2", slice_keys, "_v") - F.col("_c2"))
        .drop("_lo", "_hi")
        .withColumnRenamed("_v", "_x")
    )
    rank = F.col("_r") - F.col("_before")
    matched = targets.join(counts, [*keys, "_b"])
    return matched.where(
        F.col("_x").between(F.col("_lo"), F.col("_hi"))
        & (rank >= F.col("_before2"))
        & (rank < F.col("_before2") + F.col("_c2"))
    ).drop("_c2", "_before2")


def approximate_statistics(
    df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None, accuracy: int = 10_000
) -> DataFrame:
    """Same columns in one pass, quantiles within ``n / accuracy`` ranks."""
    v = null_nan(F.col(value).cast("double"))
    rows = df.select(*(by or []), v.alias("_v")).dropna(subset=["_v", *(by or [])])
    return rows.groupBy(*(by or [])).agg(
        F.count("_v").alias("n"),
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("std"),
        F.percentile_approx("_v", [float(p) for p in probabilities], accuracy).alias("q"),
    )
