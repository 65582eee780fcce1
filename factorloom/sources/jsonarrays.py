"""One JSON array of objects, larger than a task, cut into records with the file still split.

The file is read in pieces that end at a closing brace, so that a task finds pieces in
its block however the array is laid out, also on one line. What a piece does depends
on whether it starts inside a string and how many objects are open. Both are prefix sums over the
file: quotes that are not escaped give the first, and braces outside strings, counted for
both cases, the second. Each block is summed by itself, blocks (one row each) are
chained, and a record ends where no object is open any more. A record of one piece,
every flat one without a brace in a text, is not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.session import stage


def _counted(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pieces with their unescaped quotes and the objects they open, by whether they start outside or inside a string."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    outside = F.regexp_replace(plain, r'"[^"]*("|\z)', "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*("|\z)', ""), r'"[^"]*("|\z)', "")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("lineSep", "}")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            "value",
            _counted(plain, '"').alias("quotes"),
            F.array(_counted(outside, "{"), _counted(inside, "{")).alias("opened"),
        )
    )


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, block, record, text``: the objects of the arrays in all files, as JSON text.

    ``block`` and ``record`` tell in which block of the file a record starts and its place there.
    """
    inside = Window.partitionBy("path", "block").orderBy("row")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    pieces = _pieces(spark, path).withColumn("quotes_before", F.coalesce(F.sum("quotes").over(so_far), F.lit(0)))
    # objects open after a piece less those before it, by the state the block starts in; a piece ends with a brace
    def change(odd: int) -> Column:
        state = (F.col("quotes_before") + odd) % 2
        ends_outside = (state + F.col("quotes")) % 2 == 0
        return F.get("opened", state.cast("int")) - F.when(ends_outside, 1).otherwise(0)

    changed = pieces.withColumn("change", F.array(change(0), change(1)))
    kept = stage(
        changed.select(
            *("path", "block", "row", "value", "quotes", "quotes_before", "opened", "change"),
            F.array(*(F.coalesce(F.sum(F.get("change", F.lit(k))).over(so_far), F.lit(0)) for k in (0, 1))).alias("depth"),
        ),
        "json-pieces",
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block
    blocks = kept.groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"), *(F.sum(F.get("change", F.lit(k))).alias(f"change{k}") for k in (0, 1))
    )
    entered = blocks.withColumn("odd", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int"))
    moved = F.when(F.col("odd") == 0, F.col("change0")).otherwise(F.col("change1"))
    entered = entered.withColumn("base", F.coalesce(F.sum(moved).over(earlier), F.lit(0)))
    open_before = F.col("base") + F.get("depth", F.col("odd"))
    state = ((F.col("quotes_before") + F.col("odd")) % 2).cast("int")
    placed = kept.join(stage(entered.select("path", "block", "odd", "base"), "json-blocks"), ["path", "block"]).select(
        *("path", "block", "row", "value", "base"),
        open_before.alias("before"),
        (open_before + F.get("change", F.col("odd"))).alias("after"),
        F.get("opened", state).alias("opened"),
    )
    # behind the last record there is no brace any more
    placed = placed.where("before > 0 or opened > 0").withColumn("ends", F.col("after") <= 0)
    numbered = placed.withColumn("number", F.coalesce(F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(so_far), F.lit(0)))
    numbered = stage(numbered.select("path", "block", "row", "value", "base", "before", "ends", "number"), "json-numbered")
    # a record still open at a block's end goes on in the blocks behind it
    starts = numbered.groupBy("path", "block").agg(F.max("base").alias("base"), F.sum(F.when(F.col("ends"), 1).otherwise(0)).alias("total"))
    begun = F.when((F.col("base") == 0) | (F.col("total") > 0), F.struct("block", F.col("total").alias("record")))
    opens = stage(starts.select("path", "block", F.last(begun, ignorenulls=True).over(earlier).alias("open")), "json-open")
    carried = (F.col("number") == 0) & (F.col("base") > 0)
    named = numbered.join(opens, ["path", "block"]).select(
        "path",
        F.when(carried, F.col("open.block")).otherwise(F.col("block")).alias("block"),
        F.when(carried, F.col("open.record")).otherwise(F.col("number")).cast("long").alias("record"),
        F.struct(F.col("block").alias("at"), "row", "value").alias("piece"),
        (F.col("ends") & (F.col("before") == 0)).alias("alone"),
    )
    whole = lambda text: F.concat(F.regexp_replace(text, r"\A[\s,\[\x{FEFF}]+", ""), F.lit("}"))
    one = named.where("alone").select("path", "block", "record", whole(F.col("piece.value")).alias("text"))
    # the pieces of one record
    several = named.where("not alone").groupBy("path", "block", "record").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = F.array_join(F.transform("pieces", lambda p: p["value"]), "}")
    return one.unionByName(several.select("path", "block", "record", whole(joined).alias("text")))


def read_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The objects of JSON arrays as rows, labelled with ``source_file``; one that does not parse is an error."""
    found = array_records(spark, path)
    row = F.from_json("text", schema, {"mode": "FAILFAST"})
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(row.alias("_row"), name.alias("source_file")).select("_row.*", "source_file")
