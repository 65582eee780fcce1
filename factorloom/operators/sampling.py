"""Reproducible samples and splits by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.text import hash_key
from factorloom.operators.sizing import sized_broadcast

_BUCKET_DIGITS = 4


#: Up to so many rows a sample is a top-n, which gathers it in one partition.
TOP_ROWS = 20_000


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int | str = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the smallest by hash.

    A small sample is a distributed top-n; a larger one, of the same rows, is
    decided by hash prefix and stays spread over the partitions.
    """
    if n > TOP_ROWS:
        return mark_share(df, 1.0, key, seed=seed, out="_in", count=n).where("_in").drop("_in")
    order = hash_key(*[F.col(k) for k in key], seed=seed)
    return df.orderBy(order, *key).limit(n)


def sample_flagged(df: DataFrame, flag: str, n: int, key: list[str], seed: int | str = 42) -> DataFrame:
    """``n`` sampled rows where ``flag`` holds; if none does, of all rows.

    One look for a first flagged row settles which rows are sampled; the sample is that of
    ``sample_rows``, so a large one stays spread.
    """
    wanted = df.where(F.coalesce(F.col(flag), F.lit(False)))
    return sample_rows(df if wanted.select(flag).isEmpty() else wanted, n, key, seed)


def mark_share(
    df: DataFrame,
    share: float,
    key: list[str],
    by: list[str] | None = None,
    seed: int | str = 42,
    out: str = "selected",
    rounding: str = "floor",
    count: int | None = None,
) -> DataFrame:
    """Mark exactly ``int(share * n)`` rows, or ``count`` of them, overall or per stratum.

    Rows are ordered by a hash of their unique key. Counts per hash prefix find
    the prefix the cut falls into; rows of other prefixes are decided by
    comparison and only that one prefix (1/65,536 of a stratum) is ranked.
    """
    groups = list(by or [])
    strata = [f"_k{i}" for i in range(len(groups) or 1)]
    rows = df.withColumn("_hash", hash_key(*[F.col(k) for k in key], seed=seed)).withColumn(
        "_prefix", F.substring("_hash", 1, _BUCKET_DIGITS)
    )
    if groups:
        for name, source in zip(strata, groups):
            rows = rows.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    else:
        rows = rows.withColumn(strata[0], F.lit(""))
    stratum = Window.partitionBy(*strata)
    upto = stratum.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.ceil if rounding == "ceil" else F.floor
    total = F.sum("_c").over(stratum)
    wanted = whole(F.lit(float(share)) * total) if count is None else F.least(F.lit(count), total)
    cut = (
        rows.groupBy(*strata, "_prefix")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_want", wanted)
        .withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        .where((F.col("_before") < F.col("_want")) & (F.col("_want") <= F.col("_before") + F.col("_c")))
        .select(*strata, F.col("_prefix").alias("_cut"), (F.col("_want") - F.col("_before")).alias("_left"))
    )
    if groups:
        placed = rows.join(sized_broadcast(cut), strata, "left")
        at, left = F.col("_cut"), F.col("_left")
    else:
        row = cut.head()
        placed = rows
        at, left = F.lit(row["_cut"] if row else None), F.lit(row["_left"] if row else 0)
    on_cut = F.coalesce(F.col("_prefix") == at, F.lit(False))
    decided = placed.where(~on_cut).withColumn(out, F.coalesce(F.col("_prefix") < at, F.lit(False)))
    rank = F.row_number().over(stratum.orderBy("_hash", *key))
    ranked = placed.where(on_cut).withColumn(out, rank <= left)
    return decided.unionByName(ranked).select(*df.columns, out)


def split_share(df: DataFrame, share: float, key: list[str], seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together hold every row."""
    marked = mark_share(df, share, key, seed=seed, out="_in")
    return marked.where("_in").drop("_in"), marked.where("not _in").drop("_in")
