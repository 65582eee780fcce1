"""Column types of text tables that disagree, from one mergeable aggregate.

A value has a class: boolean, whole number, decimal number, date, time or text. The
classes met in a column are a set, kept as bits; sets merge by ``bit_or``, in any
order, within a task, over files and over groups of files. What a set stands for is read
off in the end, so a column that is numeric in one file and text in another is text
everywhere, with every value as it was written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.constants import NULL_TOKENS
from factorloom.functions.numbers import NUMERIC_TEXT
from factorloom.functions.text import WHITESPACE

BOOLEAN, WHOLE, NUMBER, DATE, TIME, TEXT = (1 << k for k in range(6))

_BOOLEAN = rf"(?i)\A[{WHITESPACE}]*(?:true|false)[{WHITESPACE}]*\z"
_WHOLE = rf"\A[{WHITESPACE}]*[+-]?[0-9]{{1,19}}[{WHITESPACE}]*\z"
_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}"


def value_class(value: Column, nulls: list[str] = NULL_TOKENS) -> Column:
    """Bit of a text value's class, 0 for a missing one."""
    return (
        F.when(value.isNull() | value.isin(nulls), 0)
        .when(value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(), WHOLE)
        .when(value.rlike(NUMERIC_TEXT), NUMBER)
        .when(value.rlike(_BOOLEAN), BOOLEAN)
        .when(value.rlike(_DATE) & value.try_cast("date").isNotNull(), DATE)
        .when(value.rlike(_TIME) & value.try_cast("timestamp").isNotNull(), TIME)
        .otherwise(TEXT)
    )


def join_type(classes: int) -> str:
    """Least type that holds every class of a set; a column without values is text."""
    if classes == BOOLEAN:
        return "boolean"
    if classes == WHOLE:
        return "bigint"
    if classes and not classes & ~(WHOLE | NUMBER):
        return "double"
    if classes == DATE:
        return "date"
    if classes and not classes & ~(DATE | TIME):
        return "timestamp"
    return "string"


def class_sets(df: DataFrame, keep: dict[str, list[str]] | None = None) -> DataFrame:
    """``column, classes`` of a table of texts: one row per column, computed in one pass."""
    sets = []
    for name in df.columns:
        nulls = [w for w in NULL_TOKENS if w not in (keep or {}).get(name, [])]
        found = F.coalesce(F.bit_or(value_class(F.col(f"`{name}`"), nulls)), F.lit(0))
        sets.append(F.struct(F.lit(name).alias("column"), found.cast("int").alias("classes")))
    return df.agg(F.array(*sets).alias("sets")).select(F.inline("sets"))


def column_types(tables: list[DataFrame], keep: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Type of every column over all ``tables`` of texts, in one job; the driver gets a row per column."""
    parts = [class_sets(t, keep) for t in tables if t.columns]
    if not parts:
        return {}
    found = reduce(DataFrame.unionAll, parts).groupBy("column").agg(F.bit_or("classes").alias("classes"))
    return {r["column"]: join_type(r["classes"]) for r in found.collect()}


def typed(df: DataFrame, types: dict[str, str], keep: dict[str, list[str]] | None = None) -> DataFrame:
    """Texts as values of the given types; null-like words are null."""
    out = []
    for name in df.columns:
        kind, value = types.get(name, "string"), F.col(f"`{name}`")
        nulls = [w for w in NULL_TOKENS if w not in (keep or {}).get(name, [])]
        value = F.when(~value.isin(nulls), value)
        if kind == "double":
            value = F.regexp_extract(value, NUMERIC_TEXT, 1).try_cast("double")
        elif kind != "string":
            value = value.try_cast(kind)
        out.append(value.alias(name))
    return df.select(*out)
