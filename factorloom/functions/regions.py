"""Region lookups and country standardisation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.constants import (
    COUNTRY_CODES,
    FACTOR_REGION_CODES,
    FACTOR_REGION_DEFAULT,
    GRAPH_REGION_CONTINENTS,
    GRAPH_REGION_NAMES,
    MULTIPLIER_REGION_CODES,
    REST_OF_WORLD_DEFAULT,
    REST_OF_WORLD_LADDER,
)
from factorloom.functions.text import col, first_listed, first_match, strip


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(entries: dict[str, str]) -> Column:
    """A fixed dictionary as a map literal: looked up in place, no join."""
    return F.expr("map(" + ", ".join(f"{text_literal(x)}" for x in chain.from_iterable(entries.items())) + ")")


def lookup(c: Column | str, entries: dict[str, str], default: Column | str | None = None) -> Column:
    found = F.try_element_at(literal_map(entries), col(c))
    if default is None:
        return found
    return F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def factor_region(c: Column | str) -> Column:
    return lookup(c, FACTOR_REGION_CODES, FACTOR_REGION_DEFAULT)


def multiplier_region_code(c: Column | str) -> Column:
    return lookup(c, MULTIPLIER_REGION_CODES)


def graph_region_name(c: Column | str) -> Column:
    return lookup(c, GRAPH_REGION_NAMES, col(c))


def graph_region_continent(c: Column | str) -> Column:
    return lookup(c, GRAPH_REGION_CONTINENTS, "Unknown")


def standardize_country(c: Column | str, mode: str = "exact") -> Column:
    """Region text to a country or rest-of-world code; null stays null.

    ``reference`` takes the first listed code found anywhere in the text, so
    full names are caught by codes inside them (AUSTRIA by US). ``exact`` tries
    code equality, then the full name, then the keyword ladder.
    """
    text = F.upper(strip(c))
    names = {name.upper(): code for code, name in COUNTRY_CODES.items()}
    if mode == "reference":
        codes = list(COUNTRY_CODES)
        inside = F.get(F.array(*(F.lit(code) for code in codes)), first_listed(text, codes))
        known = F.coalesce(inside, lookup(text, names))
    elif mode == "exact":
        known = F.coalesce(F.when(text.isin(list(COUNTRY_CODES)), text), lookup(text, names))
    else:
        raise ValueError(f"unknown region mode: {mode}")
    rest = first_match(text, REST_OF_WORLD_LADDER, REST_OF_WORLD_DEFAULT)
    return F.when(text.isNotNull(), F.coalesce(known, rest))
