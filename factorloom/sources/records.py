"""Delimited text whose quoted values hold line breaks, with files still split.

A line break ends a record only where the quotes before it are even in number. How
many stand before a line is a prefix sum over its file: every block of a file counts
its own quotes, a running sum over blocks (one row per block) tells whether a block
starts inside a quoted value, and the lines of a block are numbered by record from
there. A record that began in an earlier block is put together by that block's number;
records of one line, nearly all of them, are not moved again.

A quote may also stand in a value without quotes (``5" pipe``). Where an opening quote does
not follow a separator or the start of a line, or the quotes of a file are odd in
number, counting them is no guide, and that file is read line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.session import stage

QUOTE = '"'
UTF8 = "utf-8"


def quotes_of(line: Column | str) -> Column:
    """Number of quotes in a text of any encoding that keeps ASCII bytes."""
    line = F.col(line) if isinstance(line, str) else line
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(QUOTE), F.lit("")))


def has_line_breaks(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a line has an odd number of quotes, so that a value may go on in the next one.

    One scan without a shuffle, ended by the first such line.
    """
    # the text reader ends a line where the CSV reader does, also at a carriage return
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return not lines.where(quotes_of("value") % 2 == 1).limit(1).isEmpty()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines as they are, a carriage return included, with file, block and an order inside the block."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("lineSep", "\n")
        .text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _strays(separator: str, odd: int) -> Column:
    """Whether a quote opens inside a value, in a line that starts inside quotes (``odd``) or not."""
    parts = F.split("value", QUOTE, -1)
    # the part before an opening quote: a value's end, or nothing at all (start of line or a doubled quote)
    opens = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda _, k: k % 2 == odd)
    return F.when(F.col("quotes") > 0, F.exists(opens, lambda p: ~((p == "") | p.endswith(separator)))).otherwise(F.lit(False))


def records(spark: SparkSession, path: str | list[str], separator: str = ",", charset: str = UTF8) -> DataFrame:
    """``path, block, record, text``: the records of all files, numbered inside the block where they start.

    A carriage return ahead of the line break that ends a record is dropped, one
    inside quotes is kept. Blank lines outside quotes are no records.
    """
    inside = Window.partitionBy("path", "block").orderBy("row")
    before = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = _lines(spark, path).withColumn("quotes", quotes_of("value")).withColumn("before", before)
    # by the parity a block starts with: its records so far, and strays
    starts = lambda odd: F.sum(F.when(F.col("before") % 2 == odd, 1).otherwise(0)).over(inside)
    stray = lambda odd: F.when(F.col("before") % 2 == odd, _strays(separator, 0)).otherwise(_strays(separator, 1))
    lines = stage(
        counted.select(
            *("path", "block", "row", "value", "quotes", "before"),
            F.array(starts(0), starts(1)).alias("number"),
            F.array(stray(0), stray(1)).alias("stray"),
        ),
        "csv-lines",
    )
    # one row per block
    of = lambda name, odd: F.get(name, F.lit(odd))
    blocks = lines.groupBy("path", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.array(F.max(of("number", 0)), F.max(of("number", 1))).alias("number"),
        F.array(F.max(of("stray", 0)), F.max(of("stray", 1))).alias("stray"),
    )
    whole = Window.partitionBy("path")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    entered = blocks.withColumn("odd", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).cast("int"))
    last = F.get("number", F.col("odd"))
    entered = entered.select(
        "path",
        "block",
        "odd",
        F.last(F.when(last > 0, F.struct("block", last.alias("record"))), ignorenulls=True).over(earlier).alias("open"),
        ((F.sum("quotes").over(whole) % 2 == 1) | F.max(F.get("stray", F.col("odd"))).over(whole)).alias("loose"),
    )
    number = F.get("number", F.col("odd"))
    before, behind = F.col("odd") + F.col("before"), F.col("odd") + F.col("before") + F.col("quotes")
    named = lines.join(stage(entered, "csv-blocks"), ["path", "block"]).select(
        "path",
        F.when(F.col("loose") | (number > 0), F.col("block")).otherwise(F.col("open.block")).alias("block"),
        F.when(F.col("loose"), F.col("row")).when(number > 0, number).otherwise(F.col("open.record")).cast("long").alias("record"),
        F.struct(F.col("block").alias("at"), "row", "value").alias("line"),
        (F.col("loose") | ((before % 2 == 0) & (behind % 2 == 0))).alias("alone"),
    )
    text = lambda x: x if charset.lower() == UTF8 else F.decode(x.cast("binary"), charset)
    chomped = lambda x: F.regexp_replace(text(x), r"\r\z", "")
    one = named.where("alone").select("path", "block", "record", chomped(F.col("line.value")).alias("text"))
    # the lines of one record
    several = named.where("not alone").groupBy("path", "block", "record").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return one.where("text <> ''").unionByName(several.select("path", "block", "record", chomped(joined).alias("text")))


def without_headers(rows: DataFrame) -> DataFrame:
    """All but the first record of every file; the list of firsts has a row per file."""
    firsts = rows.groupBy("path").agg(F.min(F.struct("block", "record")).alias("_first"))
    return rows.join(firsts, "path").where(F.struct("block", "record") != F.col("_first")).drop("_first")


def parse(texts: DataFrame, columns: list[str], kinds: list[str], separator: str = ",") -> DataFrame:
    """``path`` and the values of every record's ``text``, by position."""
    places = [f"c{k}" for k in range(len(columns))]
    schema = ", ".join(f"{p} {k}" for p, k in zip(places, kinds))
    options = {"sep": separator, "escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE"}
    row = F.from_csv("text", schema, options)
    return texts.select("path", row.alias("_row")).select("path", *(F.col(f"_row.{p}").alias(c) for p, c in zip(places, columns)))
