"""Canonical schema and the explicit order key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_name", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("ef_value", T.DoubleType()),
        T.StructField("ef_unit", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("source_dataset", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def order_key(rank: int, *parts: Column) -> Column:
    """Text that sorts rows by dataset rank and then by the parts.

    Row order decides ids, primaries and keep-first rules, and files have no
    order at scale, so each source states its own. Pad numbers with
    :func:`sortable`.
    """
    return F.concat_ws("/", F.lit(f"{rank:03d}"), *parts)


def sortable(number: Column | str) -> Column:
    """A non-negative integer as text of fixed width."""
    value = F.col(number) if isinstance(number, str) else number
    return F.lpad(value.cast("string"), 19, "0")


def by_length(text: Column | str) -> Column:
    """A key that sorts shorter texts first: padded ids stay in number order when they outgrow their padding."""
    value = F.col(text).cast("string") if isinstance(text, str) else text.cast("string")
    return F.concat(F.lpad(F.length(value).cast("string"), 6, "0"), F.lit("/"), value)


def as_of_date(as_of: Column | str | None = None) -> Column:
    """Processing date as ``YYYY-MM-DD`` text; today unless given."""
    if as_of is None:
        return F.date_format(F.current_date(), "yyyy-MM-dd")
    return F.lit(as_of) if isinstance(as_of, str) else as_of
