"""Query registry and SQL assembly."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str) -> None:
    """Register a named subquery for use in oracle texts."""
    VIEWS[name] = sql


def with_views(body: str) -> str:
    """Prefix the subqueries a text refers to, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body
    clauses = ",\n".join(f"{name} AS (\n{VIEWS[name]}\n)" for name in ordered)
    own = re.match(r"WITH (RECURSIVE )?", body)
    if own:
        return f"WITH {own[1] or ''}{clauses},\n{body[own.end() :]}"
    return f"WITH {clauses}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when it has one, its SQL text."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query already registered: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return function

    return register
