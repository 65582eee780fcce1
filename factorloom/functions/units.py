"""Unit standardisation: the cascade, the exact form, and per-kilogram units."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.constants import (
    BASE_UNIT,
    BASE_UNIT_PER_KG,
    EXACT_UNIT_FACTORS,
    PER_KG_FACTORS,
)
from factorloom.functions.numbers import is_numeric_text
from factorloom.functions.text import col


class Measure(NamedTuple):
    value: Column
    unit: Column


def standardize_unit(value: Column | str, unit: Column | str, mode: str = "exact") -> Measure:
    """Convert to ``kg CO2e``.

    ``reference`` applies the ordered text cascade in closed form: a ``kg``
    unit also matches the later ``g`` pattern and every ``t``, ``kt``, ``Mt``
    or ``Gt`` spelling ends in the ``t`` rung; denominators are dropped.
    ``exact`` reads the mass word in front of ``CO2e``, uses its own factor and
    keeps the denominator.
    """
    number, text = col(value), col(unit)
    numeric = is_numeric_text(text)
    named = F.when(numeric, F.lit(BASE_UNIT)).otherwise(text)
    lowered = F.lower(named)
    if mode == "reference":
        grams = lowered.contains("g co2e")
        tonnes = lowered.contains("t co2e")
        return Measure(
            F.when(grams, number * 0.001).when(tonnes, number * 1000.0).otherwise(number),
            F.when(grams | tonnes, F.lit(BASE_UNIT)).otherwise(named),
        )
    if mode != "exact":
        raise ValueError(f"unknown unit mode: {mode}")
    words = "|".join(name.split(" ")[0].lower() for name, _ in EXACT_UNIT_FACTORS)
    pattern = rf"(?i)(?<![a-z])({words})\s+co2e"
    word = F.lower(F.regexp_extract(named, pattern, 1))
    scaled, known = None, F.lit(False)
    for name, factor in EXACT_UNIT_FACTORS:
        hit = word == name.split(" ")[0].lower()
        scaled = F.when(hit, number * factor) if scaled is None else scaled.when(hit, number * factor)
        known = known | hit
    return Measure(
        scaled.otherwise(number),
        F.when(known, F.regexp_replace(named, pattern, BASE_UNIT)).otherwise(named),
    )


def standardize_unit_per_kg(value: Column | str, unit: Column | str) -> Measure:
    """Older form: three exact spellings become ``kg CO2e/kg``."""
    number, text = col(value), col(unit)
    scaled = None
    for name, factor in PER_KG_FACTORS.items():
        step = text == name
        scaled = F.when(step, number * factor) if scaled is None else scaled.when(step, number * factor)
    return Measure(
        scaled.otherwise(number),
        F.when(text.isin(list(PER_KG_FACTORS)), F.lit(BASE_UNIT_PER_KG)).otherwise(text),
    )


def convert_unit(value: Column | str, source: Column | str, target: Column | str) -> Column:
    """Scale by the source unit's factor; unknown or equal units change nothing."""
    number = col(value)
    scaled = F.when(col(source) == col(target), number)
    for name, factor in PER_KG_FACTORS.items():
        scaled = scaled.when(col(source) == name, number * factor)
    return scaled.otherwise(number)


def per_unit(unit: Column | str, denominator: str = "USD") -> Column:
    return F.concat(col(unit), F.lit(f"/{denominator}"))
