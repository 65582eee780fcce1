"""Reading numbers and cited sources out of answer texts, and prompt layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.constants import (
    ANY_NUMBER_PATTERN,
    NUMBER_PATTERNS,
    PROMPT_CHAT_CLOSE,
    PROMPT_CHAT_END,
    PROMPT_CHAT_OPEN,
    SOURCE_LEADS,
)
from factorloom.functions.text import WHITESPACE, col


def _first_group(c: Column, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(found != "", found)


def extract_value(c: Column | str) -> Column:
    """First number in front of a known unit, else the first number, else null.

    Sign and exponent are not read, and units are matched case by case. The
    unit patterns are tried in order.
    """
    text = col(c)
    spaced = [p.replace(r"\s", f"[{WHITESPACE}]") for p in [*NUMBER_PATTERNS, ANY_NUMBER_PATTERN]]
    return F.coalesce(*[_first_group(text, p) for p in spaced]).cast("double")


def extract_source(c: Column | str) -> Column:
    """First cited source name after a lead such as ``from``, any case."""
    text = col(c)
    name = r"([\p{L}\p{N}_]+(?:[-_.][\p{L}\p{N}_]+)*)"
    leads = [lead.replace(r"\s", f"[{WHITESPACE}]") for lead in SOURCE_LEADS]
    return F.coalesce(*[_first_group(text, f"(?i){lead}{name}") for lead in leads])


def chat_prompt(instruction: Column | str, input_text: Column | str, output: Column | str) -> Column:
    """Training layout: instruction, optional input after a blank line, answer."""
    body = F.when(
        F.coalesce(col(input_text), F.lit("")) != "",
        F.concat(col(instruction), F.lit("\n\n"), col(input_text)),
    ).otherwise(col(instruction))
    return F.concat(
        F.lit(PROMPT_CHAT_OPEN), body, F.lit(PROMPT_CHAT_CLOSE), F.lit(" "), col(output), F.lit(PROMPT_CHAT_END)
    )


def template_prompt(
    instruction: Column | str,
    input_text: Column | str,
    output: Column | str | None = None,
    template: str = PROMPT_CHAT_OPEN + "{instruction} {input}" + PROMPT_CHAT_CLOSE,
) -> Column:
    """Fill a ``{instruction} {input} {output}`` template.

    A present input is put on its own line; an absent one leaves the blank in
    front of the closing marker.
    """
    given = F.coalesce(col(input_text), F.lit(""))
    values = {
        "instruction": F.coalesce(col(instruction), F.lit("")),
        "input": F.when(given != "", F.concat(F.lit("\n"), given)).otherwise(F.lit("")),
        "output": F.coalesce(col(output), F.lit("")) if output is not None else F.lit(""),
    }
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), values[name]]
    return F.concat(*pieces, F.lit(rest))
