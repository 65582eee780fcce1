"""Registry of sources: how a raw table is read and shaped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from factorloom.operators import multipliers
from factorloom.schema import as_of_date
from factorloom.sources import canonical


@dataclass(frozen=True)
class SourceSpec:
    """A named source.

    ``read`` returns the raw table with an order key, ``canonicalize`` shapes
    it. ``flags_outliers`` says whether its rows carry an outlier flag.
    """

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    canonicalize: Callable[..., DataFrame]
    flags_outliers: bool = True
    options: dict = field(default_factory=dict)

    def load(self, spark: SparkSession, path: str, as_of: str | None = None) -> DataFrame:
        return self.canonicalize(self.read(spark, path), as_of=as_of, **self.options)


def predefined(raw: DataFrame, as_of: str | None = None, order: str = canonical.ORDER) -> DataFrame:
    return multipliers.clean(raw, as_of_date(as_of), order)


CANONICALIZERS: dict[str, Callable[..., DataFrame]] = {
    "product": canonical.product,
    "period": canonical.period,
    "product_region": canonical.product_region,
    "flow": canonical.flow,
    "multiplier": canonical.multiplier,
    "predefined": predefined,
    "factor": canonical.factor,
    "pathway": canonical.pathway,
    "process": canonical.process,
}

# Three sources leave the flag empty in the merged table.
WITHOUT_OUTLIER_FLAG = {"product_region", "flow", "predefined"}


class Registry:
    """Sources by name; add one to plug a new dataset in."""

    def __init__(self) -> None:
        self._specs: dict[str, SourceSpec] = {}

    def add(self, spec: SourceSpec) -> None:
        if spec.name in self._specs:
            raise ValueError(f"source already registered: {spec.name}")
        self._specs[spec.name] = spec

    def __iter__(self):
        return iter(self._specs.values())

    def load_all(self, spark: SparkSession, paths: dict[str, str], as_of: str | None = None) -> dict[str, DataFrame]:
        return {s.name: s.load(spark, paths[s.name], as_of) for s in self if s.name in paths}
