"""Tag arrays: building, parsing and sector extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions.numbers import double_text, is_digits
from factorloom.functions.text import col, strip

STRICT_JSON = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def empty_tags() -> Column:
    return F.array().cast("array<string>")


def tag(prefix: str, value: Column | str) -> Column:
    """``prefix:value``, null when the value is null."""
    return F.concat(F.lit(f"{prefix}:"), col(value).cast("string"))


def tag_array(*entries: Column) -> Column:
    """Array of the non-null tags, in order."""
    return F.array_compact(F.array(*entries))


def naics_tag(code: Column | str) -> Column:
    """Industry tag from the first two digits of an all-digit code."""
    return F.when(is_digits(code, 2), F.concat(F.lit("NAICS:"), F.substring(col(code), 1, 2)))


def category_tags(category: Column | str) -> Column:
    """Comma-separated category text to an array; parts are not trimmed."""
    return F.coalesce(F.split(col(category), ","), empty_tags())


def parse_lenient(text: Column | str) -> Column:
    """Quote-tolerant list text to an array; anything unreadable to empty."""
    quoted = F.translate(col(text), "'", '"')
    is_list = strip(quoted).startswith("[") & strip(quoted).endswith("]")
    parsed = F.from_json(quoted, "array<string>", STRICT_JSON)
    return F.coalesce(F.when(is_list, parsed), empty_tags())


def parse_strict(text: Column | str) -> Column:
    """Strict JSON: list as is, scalar to one element, other text kept whole."""
    raw = col(text)
    body = strip(raw)
    as_list = F.from_json(raw, "array<string>", STRICT_JSON)
    integer = body.rlike(r"\A-?(0|[1-9][0-9]*)\z")
    real = body.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")
    is_string = body.rlike(r'(?s)\A"([^"\\]|\\.)*"\z') & quoted.isNotNull()
    return (
        F.when(raw.isNull(), empty_tags())
        .when(body.startswith("[") & body.endswith("]") & as_list.isNotNull(), as_list)
        .when(integer, F.array(body))
        .when(real, F.array(double_text(body.try_cast("double"))))
        .when(is_string, F.array(quoted))
        .when(body == "true", F.array(F.lit("True")))
        .when(body == "false", F.array(F.lit("False")))
        .when(body == "null", F.array(F.lit("None")))
        .otherwise(F.array(raw))
    )


def with_prefix(tags: Column | str, prefix: str) -> Column:
    """Values of the tags that start with ``prefix``, prefix removed."""
    chosen = F.filter(F.coalesce(col(tags), empty_tags()), lambda t: t.startswith(prefix))
    return F.transform(chosen, lambda t: F.replace(t, F.lit(prefix), F.lit("")))


def sectors(tags: Column | str) -> Column:
    return with_prefix(tags, "sector:")


def sectors_or_type(tags: Column | str, entity_type: Column | str) -> Column:
    """Candidate sectors of a fact: its sector tags, else its entity type."""
    found = sectors(tags)
    kind = col(entity_type)
    fallback = F.when(kind.isNotNull() & (kind != ""), F.array(kind)).otherwise(empty_tags())
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def metadata_json(*fields: Column) -> Column:
    """Named columns to one JSON object, null fields kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
