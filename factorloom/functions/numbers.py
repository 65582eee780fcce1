"""Numeric coercion, NaN handling and number-to-text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.text import WHITESPACE, col, strip

_NUMBER = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?)"
NUMERIC_TEXT = rf"(?i)\A[{WHITESPACE}]*({_NUMBER})[{WHITESPACE}]*\z"


def null_nan(c: Column | str) -> Column:
    """NaN counts as missing everywhere; Spark aggregates would propagate it."""
    return F.nanvl(col(c), F.lit(None).cast("double"))


def coerce_numeric(c: Column | str) -> Column:
    """Text to double, anything unparsable to null.

    The pattern keeps Java-only spellings such as ``2d`` or ``1f`` out. It is
    the only use of the input, so a long expression is not evaluated twice.
    """
    return F.regexp_extract(col(c).cast("string"), NUMERIC_TEXT, 1).try_cast("double")


def number_column(df: DataFrame, name: str) -> Column:
    """A column as double: parsed when it is text, only freed of NaN when numeric."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return null_nan(F.col(f"`{name}`").cast("double"))
    return coerce_numeric(F.col(f"`{name}`"))


def double_text(c: Column | str) -> Column:
    """Shortest decimal text: plain digits for 1e-4 <= |x| < 1e16.

    Spark switches to ``1.0E9`` at 1e7; those values go through a decimal.
    """
    plain = col(c).cast("string")
    magnitude = F.abs(col(c))
    decimal = plain.try_cast("decimal(38,20)").cast("string")
    digits = F.regexp_replace(decimal, r"0+\z", "")
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    exponent = F.regexp_replace(plain, r"\.0E", "E")
    exponent = F.regexp_replace(exponent, r"E(\d)\z", "e+0$1")
    exponent = F.regexp_replace(exponent, r"E(\d+)\z", "e+$1")
    exponent = F.regexp_replace(exponent, r"E-(\d)\z", "e-0$1")
    exponent = F.regexp_replace(exponent, r"E-(\d+)\z", "e-$1")
    return (
        F.when(~plain.contains("E"), plain)
        .when((magnitude >= 1e-4) & (magnitude < 1e16), digits)
        .otherwise(exponent)
    )


def is_digits(c: Column | str, at_least: int = 1) -> Column:
    return col(c).rlike(rf"\A[0-9]{{{at_least},}}\z")


def is_numeric_text(c: Column | str) -> Column:
    """Only digits and dots: a number that slipped into a text column."""
    return col(c).rlike(r"\A[0-9.]+\z")


def percent_error(predicted: Column, actual: Column) -> Column:
    """Absolute percentage error, null when the actual value is zero."""
    return F.abs(F.try_divide(predicted - actual, actual)) * 100


def parse_flag(c: Column | str) -> Column:
    """Text or boolean to boolean: true only for ``true`` in any case."""
    return F.coalesce(F.lower(strip(col(c).cast("string"))) == "true", F.lit(False))


def flag_column(df: DataFrame, name: str) -> Column:
    """A column as a boolean without nulls: read as text only when it is text, false where it is missing."""
    if name not in df.columns:
        return F.lit(False)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.coalesce(F.col(name), F.lit(False))
    return parse_flag(name)
