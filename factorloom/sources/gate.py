"""Sanity checks on landed files."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.constants import (
    SANITY_MIN_COLUMNS,
    SANITY_MIN_LINES,
    SANITY_PREFIX_CHARS,
    TABLE_HEADER_PREFIXES,
)
from factorloom.functions.text import col, strip
from factorloom.operators.ordering import top_per_group
from factorloom.operators.sizing import sized_broadcast

#: First lines in which most files have all the characters that are looked at.
OPENING_LINES = 100


def _checks(head: Column, columns: Column, lines: Column, min_columns: int, min_lines: int) -> list[Column]:
    html = head.contains("<html") | head.contains("<!doctype html")
    comma = head.contains(",")
    return [
        html.alias("is_html"),
        comma.alias("has_comma"),
        columns.alias("columns"),
        lines.alias("lines"),
        (~html & comma & (columns >= min_columns) & (lines >= min_lines)).alias("accepted"),
    ]


def verdict(
    text: Column | str, min_columns: int = SANITY_MIN_COLUMNS, min_lines: int = SANITY_MIN_LINES
) -> list[Column]:
    """Check columns for a file held in one text: web page, delimited, wide and long enough."""
    head = F.lower(F.substring(col(text), 1, SANITY_PREFIX_CHARS))
    columns = F.size(F.split(F.substring_index(col(text), "\n", 1), ","))
    breaks = F.length(col(text)) - F.length(F.replace(col(text), F.lit("\n"), F.lit("")))
    lines = breaks + F.when((col(text) != "") & ~col(text).endswith("\n"), F.lit(1)).otherwise(F.lit(0))
    return _checks(head, columns, lines, min_columns, min_lines)


def check_files(
    spark: SparkSession, path: str, min_columns: int = SANITY_MIN_COLUMNS, min_lines: int = SANITY_MIN_LINES
) -> DataFrame:
    """One verdict row per file, from its lines: no file has to fit in one task.

    The first characters lie within as many first lines, which are taken from
    the file's first block.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            (F.col("_metadata.file_block_start") == 0).alias("_first_block"),
            F.monotonically_increasing_id().alias("_line"),
            "value",
        )
    )
    opening = top_per_group(lines.where("_first_block"), ["path"], ["_line"], SANITY_PREFIX_CHARS, "place")
    found = _file_verdicts(lines, opening, ["path"], min_columns, min_lines)
    checks = [c for c in found.columns if c != "path"]
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), *checks)


def check_lines(
    lines: DataFrame, keys: list[str], min_columns: int = SANITY_MIN_COLUMNS, min_lines: int = SANITY_MIN_LINES
) -> DataFrame:
    """One verdict row per file for files kept in a table of lines: ``keys`` name the file, ``place`` counts its
    lines from 1, ``value`` is the line.

    Any number of files costs no more than their lines, which are counted in place; no file has to fit in one task.
    Only first lines are moved: ``OPENING_LINES`` of every file, and up to as many as there are
    characters to see where those fall short of them.
    """
    first = lines.where(F.col("place") <= OPENING_LINES)
    short = (
        first.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("value") + 1).alias("_chars"))
        .where((F.col("_n") == OPENING_LINES) & (F.col("_chars") <= SANITY_PREFIX_CHARS))
    )
    further = lines.where(F.col("place").between(OPENING_LINES + 1, SANITY_PREFIX_CHARS)).alias("a")
    unseen = sized_broadcast(short.select(*keys)).alias("b")
    further = further.join(unseen, _same(keys), "left_semi")
    return _file_verdicts(lines, first.unionByName(further), keys, min_columns, min_lines)


def _same(keys: list[str]) -> Column:
    """The keys of sides ``a`` and ``b`` agree, nulls included."""
    return reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))


def _file_verdicts(lines: DataFrame, opening: DataFrame, keys: list[str], min_columns: int, min_lines: int) -> DataFrame:
    """Verdicts from all ``lines``, which are counted, and the ``opening`` ones with their ``place``."""
    counts = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_lines"))
    heads = opening.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("place", F.substring("value", 1, SANITY_PREFIX_CHARS).alias("t")))).alias("_top"),
        F.max(F.when(F.col("place") == 1, F.size(F.split("value", ",")))).alias("_columns"),
    )
    text = F.array_join(F.transform("_top", lambda line: line["t"]), "\n")
    head = F.lower(F.substring(text, 1, SANITY_PREFIX_CHARS))
    joined = counts.alias("a").join(heads.alias("b"), _same(keys))
    return joined.select(*(F.col(f"a.{k}") for k in keys), *_checks(head, F.col("_columns"), F.col("_lines"), min_columns, min_lines))


def is_relevant_table(header_cells: Column | str, prefixes: list[str] | None = None) -> Column:
    """True when a header cell starts with an emission word."""
    words = "|".join(prefixes or TABLE_HEADER_PREFIXES)
    return F.exists(header_cells, lambda cell: F.lower(strip(cell)).rlike(rf"\A({words})"))
