"""Finding column roles from header names. Works on metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.constants import FLOW_ROLES, FLOW_SIGNATURE, PRODUCT_REGION_ROLES, PRODUCT_ROLES


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def find_column(columns: list[str], keywords: list[str]) -> str | None:
    """First header that holds any keyword, case ignored."""
    return next((c for c in columns if any(k in c.lower() for k in keywords)), None)


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def product_roles(schema: T.StructType, override: dict[str, str] | None = None) -> dict[str, str | None]:
    """Roles of a product table. The name falls back to the first column, the
    value to the first numeric one; a table without either is an error.

    Keyword order can give the name role to an id column; ``override`` settles it.
    """
    roles = {role: find_column(schema.names, words) for role, words in PRODUCT_ROLES.items()}
    roles["name"] = roles["name"] or schema.names[0]
    roles["value"] = roles["value"] or next(iter(numeric_columns(schema)), None)
    roles.update(override or {})
    if roles["value"] is None:
        raise ValueError("no emission factor column found")
    return roles


def product_region_roles(schema: T.StructType, override: dict[str, str] | None = None) -> dict[str, str | None]:
    """Roles of a product-by-region table; the value falls back to a numeric
    column that is neither region nor product."""
    roles = {role: find_column(schema.names, words) for role, words in PRODUCT_REGION_ROLES.items()}
    if roles["value"] is None:
        taken = {roles["region"], roles["product"]}
        roles["value"] = next((c for c in numeric_columns(schema) if c not in taken), None)
    roles.update(override or {})
    if roles["value"] is None:
        raise ValueError("no emission factor column found")
    return roles


def flow_roles(schema: T.StructType, override: dict[str, str] | None = None) -> dict[str, str | None]:
    """Roles of a legacy flow table; the value falls back to a numeric column other than the year."""
    roles = {role: find_column(schema.names, words) for role, words in FLOW_ROLES.items()}
    if roles["value"] is None:
        roles["value"] = next((c for c in numeric_columns(schema) if c.lower() != "year"), None)
    roles.update(override or {})
    return roles


def has_flow_signature(columns: list[str]) -> bool:
    return set(FLOW_SIGNATURE) <= set(columns)


def column_or(df: DataFrame, name: str | None, default: Column) -> Column:
    return F.col(f"`{name}`") if name and name in df.columns else default
