"""Published sets as one commit: versioned parts, and a manifest that is written last.

Every part of a set goes to a folder of its own, named by the set's number. The manifest
row of each part (folder, rows, root hash) is added by one write of one file, which
a file system shows whole or not at all, after all parts are there. Readers go through the
manifest, so a run that dies between two parts leaves the set before it in force, and its
folders are known to nobody.

A source is known by the root of its raw rows. As long as that stays, its shaped rows are taken
from the snapshot that an earlier set names, without shaping them again.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.hashtree import row_hash
from factorloom.session import spread
from factorloom.sources.registry import Registry

_MANIFEST = "number long, part string, kind string, path string, rows long, root string, source_root string"


def content_root(df: DataFrame) -> tuple[int, str]:
    """Rows and hash of all rows in any order: one pass, a few sums per task."""
    part = lambda start: F.conv(F.substring("_md5", start, 15), 16, 10).cast("decimal(38,0)")
    texts = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in df.dtypes]
    sums = df.select(*texts).select(row_hash(df.columns).alias("_md5")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("a"), F.sum(part(16)).alias("b")
    )
    text = F.concat_ws("|", F.lit(",".join(df.columns)), F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    found = sums.select("rows", F.md5(text).alias("root")).head()
    return found["rows"], found["root"]


class Published:
    """A folder of published sets. One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """All rows of all committed sets."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def number(self) -> int:
        """Number of the set in force, 0 before the first one."""
        return self.manifest().agg(F.coalesce(F.max("number"), F.lit(0))).head()[0]

    def current(self) -> DataFrame:
        """Manifest rows of the set in force."""
        return self.manifest().where(F.col("number") == self.number())

    def read(self, part: str, schema: str | None = None) -> DataFrame:
        """A part of the set in force, as parquet or by the format it was written in."""
        row = self.current().where(F.col("part") == part).select("path", "kind").head()
        if row is None:
            raise ValueError(f"no published part {part} in {self.path}")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.format(row["kind"]).load(row["path"])

    def begin(self) -> "Writing":
        return Writing(self)


class Writing:
    """Parts of the next set; nothing is seen of them before :meth:`commit`."""

    def __init__(self, published: Published):
        self.published, self.spark = published, published.spark
        self.before = published.number()
        self.folder = f"{published.path}/sets/{self.before + 1:08d}-{uuid.uuid4().hex[:8]}"
        self.rows: list[tuple] = []

    def path(self, part: str) -> str:
        return f"{self.folder}/{part}"

    def add(
        self,
        part: str,
        kind: str,
        df: DataFrame,
        write: Callable[[str], None],
        source_root: str | None = None,
        known: tuple[int, str] | None = None,
    ) -> tuple[int, str]:
        """Write a part with ``write`` and note the rows and the root of ``df``, which come back.

        ``known`` are those of another part written from the same ``df``.
        """
        write(self.path(part))
        rows, root = known or content_root(df)
        self.rows.append((self.before + 1, part, kind, self.path(part), rows, root, source_root))
        return rows, root

    def interim(self, name: str, raw: DataFrame, shape: Callable[[DataFrame], DataFrame], how: str = "") -> DataFrame:
        """Shaped rows of a source: the snapshot of the set in force if raw rows and ``how`` are the same, else a new one.

        ``how`` names what else the shaped rows depend on.
        """
        part = f"interim/{name}"
        raw = spread(raw)
        source_root = f"{content_root(raw)[1]}|{how}"
        known = self.published.current().where((F.col("part") == part) & (F.col("source_root") == source_root)).head()
        if known is not None:
            self.rows.append((self.before + 1, part, "parquet", known["path"], known["rows"], known["root"], source_root))
            return self.spark.read.parquet(known["path"])
        shaped = shape(raw)
        shaped.write.mode("errorifexists").parquet(self.path(part))
        written = self.spark.read.schema(shaped.schema).parquet(self.path(part))
        rows, root = content_root(written)
        self.rows.append((self.before + 1, part, "parquet", self.path(part), rows, root, source_root))
        return written

    def commit(self) -> int:
        """Put the set in force by one file; refused if another one was committed meanwhile."""
        if self.published.number() != self.before:
            raise RuntimeError(f"another set was published in {self.published.path} meanwhile")
        self.spark.createDataFrame(self.rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.published.path}/manifest")
        return self.before + 1


def load_interim(spark: SparkSession, registry: Registry, paths: dict[str, str], writing: Writing, as_of: str | None = None) -> dict[str, DataFrame]:
    """Shaped rows of every registered source that has a path, from snapshots where its raw rows are unchanged.

    A shaped row holds the date ``as_of``, so another date (today's, unless given) shapes it anew.
    """
    as_of = as_of or datetime.date.today().isoformat()
    loaded = {}
    for spec in registry:
        if spec.name in paths:
            shape = lambda raw, spec=spec: spec.canonicalize(raw, as_of=as_of, **spec.options)
            loaded[spec.name] = writing.interim(spec.name, spec.read(spark, paths[spec.name]), shape, f"{as_of}|{sorted(spec.options.items())}")
    return loaded
