"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected copies, target over size of the
source. Within a source, documents stand in the order of their sizes, their
expected copies are summed up along that order, one random offset per source is
added, and a document is emitted once for every integer boundary its stretch
crosses. In that order the words taken stay within about one long document of the
target. The sums need a document's rank in its source only, which comes from one
range-partitioned write and a count per partition, so that a source with a third
of all rows is spread over many tasks.

Targets: the sources share ``share`` times all words by weight; one that would
exceed ``most_copies`` times its words stops there and the excess is shared anew.

Defined cases: a null text has size 0; a null source is a source of its own, the
last; empty sources get nothing; repeated rows are documents of their own; ties in
size are ordered by a seeded hash, then id; an empty table gives no row; all
columns of the input come back from ``mix``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import ROW, tagged, word_count
from factorloom.operators.ordering import dense_index
from factorloom.operators.sizing import sized_broadcast
from factorloom.session import cut_lineage, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
SEED = 17


def source_targets(
    sized: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
) -> DataFrame:
    """``source, source_size, target`` for every source of ``sized`` (``source, size``).

    Sharing out is repeated as long as a source lies above its limit. Each step is
    one sum over the source table; only three numbers come to the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = dense_index(totals.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_place", 0)
    cycle = F.array(*(F.lit(w) for w in weights))
    table = cut_lineage(
        ordered.select(
            "source", "source_size", F.get(cycle, (F.col("_place") % len(weights)).cast("int")).alias("weight")
        )
    )
    limit = F.col("source_size") * most_copies
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    above = F.lit(False)
    while True:
        n, taken, free = table.agg(
            F.coalesce(F.sum(F.when(above, 1)), F.lit(0)),
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (wanted - taken) / free
        above = F.lit(level) * F.col("weight") > limit
    target = F.when(above, limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on source and seed."""
    text = F.concat(F.coalesce(source, F.lit("\x00")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def copies(rows: DataFrame, seed: int = SEED, **sharing: object) -> DataFrame:
    """``_row, doc_id, source, size, source_size, target, n_copies`` for tagged ``_row, doc_id, source, size``."""
    hashed = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(str(seed))))
    order = ["source", "size", "_hash", "doc_id", ROW]
    place = F.monotonically_increasing_id()
    placed = stage(
        rows.select(ROW, "doc_id", "source", "size", hashed.alias("_hash"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.shiftright(place, 33))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_hash"),
        "mix-order",
    )
    runs = placed.groupBy("_slot", "source").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # a source has at most one run per partition
    ahead = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0))).drop("_rows")
    targets = source_targets(placed.select("source", "size"), **sharing).withColumnRenamed("source", "_of")
    runs = runs.withColumnsRenamed({"_slot": "_in", "source": "_whose"})
    runs = runs.join(targets, F.col("_whose").eqNullSafe(F.col("_of"))).drop("_of")
    # at most one row for each partition and source
    runs = sized_broadcast(runs)
    same = (F.col("_slot") == F.col("_in")) & F.col("source").eqNullSafe(F.col("_whose"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("_place") - F.col("_first") + F.col("_ahead")
    return (
        placed.join(runs, same)
        .withColumn("_rate", rate)
        .withColumn("_rank", rank)
        .withColumn("_offset", _offset(F.col("source"), seed))
        .withColumn(
            "n_copies",
            (
                F.floor(F.col("_rate") * (F.col("_rank") + 1) + F.col("_offset"))
                - F.floor(F.col("_rate") * F.col("_rank") + F.col("_offset"))
            ).cast("int"),
        )
        .select(ROW, "doc_id", "source", "size", "source_size", "target", "n_copies")
    )


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object
) -> DataFrame:
    """Copies of every row, without its text."""
    return copies(tagged(sized(docs, id_col, text_col, source_col), "mix-sizes"), **options)


def _keyed(docs: DataFrame, rows: list[Column], stored: bool) -> DataFrame:
    """``rows`` of ``docs`` and a key of each row that stays the same when they are read again."""
    if stored and "_metadata" not in docs.columns:
        # the place in its file names a row of a written table, so nothing is written again
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        try:
            return docs.select(*rows, place.alias(ROW))
        except AnalysisException:
            pass  # not a scan of files after all
    return tagged(docs.select(*rows), "mix-rows")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    stored: bool = False,
    **options: object,
) -> DataFrame:
    """The mixed rows with all columns of ``docs``, each row as often as it is taken.

    ``stored``: ``docs`` is the plain scan of written parquet files. Any other table is written once, to
    give its rows a key.
    """
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole")
    size = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    rows = _keyed(docs, [whole_row, *size], stored)
    taken = copies(rows.drop("_whole"), **options).where(F.col("n_copies") > 0).select(ROW, "n_copies")
    return (
        rows.select(ROW, "_whole")
        .join(taken, ROW)
        .select("_whole", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .select("_whole.*")
    )


def digest(planned: DataFrame) -> DataFrame:
    return planned.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken")
    )
