"""Small document tables with the cases every operator must stand."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row string, size string"


def documents(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    """Rows of (doc_id, text[, source[, lang]]) with extra columns whose names operators use themselves."""
    full = [
        (r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), "x", "y", "z")
        for r in rows
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


LONG = " ".join(f"word{k % 997}x{k}" for k in range(30_000))

ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "One line"),
    (4, "One line"),
    (5, "É wide spaces \U0001f600 end"),
    (6, LONG),
    (None, "no id here"),
    (None, None),
    (7, "One\t\tline"),
]
