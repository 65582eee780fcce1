"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. Only blobs
for which the ledger has no entry under the wanted rule version are scanned, each
once however many paths hold it; findings are joined back to all paths. The new
entries are appended to the ledger table (``Ledger``), so that the next load scans new
content only. An append that dies leaves the entries before it; one that is repeated
adds equal entries, which count once.

A rule is a pattern and a test of what it matched. Matches are leftmost and do
not overlap within a rule; those that fail the test are dropped. Positions are
code points: the text is split at the matches, and a match starts behind all
pieces and matches ahead of it.

Defined cases: a null text is the empty text; rows with equal texts share one
scan, whatever their ids; a null id and repeated rows keep their findings; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.llm.common import whole
from factorloom.session import scratch_path, stage

RULE_VERSION = "1"


@dataclass(frozen=True)
class Rule:
    """``group``: the capture that must have ``least`` code points (0: the whole match)."""

    kind: str
    pattern: str
    group: int
    least: int


#: Ranked as listed; the first three are the base kinds. Where a match is a run of
#: one class, the least length stands in the pattern, which finds the same runs.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 20),
)
BASE_KINDS = 3
#: Matches whose spans are collected in one list before the lists are joined.
RUN = 256

_SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(text: Column, rank: int, rule: Rule) -> Column:
    """Spans of one rule in a text: ``start, rank, kind, end``."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), 1)
    tested = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), rule.group + 1) if rule.group else found
    rows = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("size"),
        F.transform(tested, lambda x: F.length(x)).alias("tested"),
    )
    empty = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(x["tested"] >= rule.least, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    def run_of(found: Column, k: Column) -> Column:
        return F.slice(found, k * RUN + 1, F.lit(RUN))

    def step_run(state: Column, run: Column) -> Column:
        inner = F.aggregate(run, F.struct(state["at"].alias("at"), empty.alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["spans"], F.array(inner["spans"])).alias("spans"))

    def walk(found: Column) -> Column:
        # a list that grows is copied at every step: short lists of runs, put together once, keep that in proportion
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")), lambda k: run_of(found, k))
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("spans"))
        return F.flatten(F.aggregate(runs, start, step_run, lambda s: s["spans"]))

    # the pieces are one bound variable, so the pattern is not run again for every run; only texts that may hold a match get here
    walked = F.get(F.transform(F.array(rows), walk), F.lit(0))
    return F.when(text.rlike(rule.pattern), walked).otherwise(empty)


def address(text: Column) -> Column:
    """The content address of a text."""
    return F.sha2(whole(text), 256)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger entries of blobs (``blob, text``): ``blob, rule_version, spans`` ordered by start and rank."""
    text = F.col("text")
    spans = F.array_sort(F.concat(*(_spans(text, k, rule) for k, rule in enumerate(rules))))
    return blobs.select("blob", F.lit(version).alias("rule_version"), spans.alias("spans"))


def scan_new(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    version: str = RULE_VERSION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``(findings, entries)``: spans of every row (``doc_id, blob, spans``) and the new ledger entries.

    The row that stands for a blob is the one with the smallest key of those that
    hold it, found from addresses alone; texts move once, to meet the unseen blobs.
    """
    text = whole(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("blob"))
    source = source.withColumn("holder", F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id")))
    paths = stage(source.select("doc_id", "blob", "holder"), "secret-paths")
    unseen = paths.groupBy("blob").agg(F.min("holder").alias("holder"))
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == version).select("blob")
        unseen = unseen.join(done, "blob", "left_anti")
    blobs = source.select("blob", "holder", "text").join(unseen, ["blob", "holder"], "left_semi")
    # equal rows of one holder are scanned together and give the same spans
    entries = stage(scan(blobs, rules, version), "secret-entries").dropDuplicates(["blob", "rule_version"])
    known = entries
    if ledger is not None:
        known = entries.unionByName(ledger.where(F.col("rule_version") == version).dropDuplicates(["blob"]))
    hits = known.where(F.size("spans") > 0).select("blob", "spans")
    none = F.array().cast(_SPANS)
    findings = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))
    return findings, entries


class Ledger:
    """Ledger entries as a table in the shared folder: a folder for every append.

    ``read`` names these folders one by one. Two scans of one folder count as equal in a plan,
    also where files came between them, and one would be answered from the other.
    """

    SCHEMA = f"blob string, spans {_SPANS}, rule_version string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "secret-ledger")
        # an empty part, so that a new ledger can be read
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.SCHEMA)]
        self.append(spark.range(0).select(*none))

    def read(self) -> DataFrame:
        """The entries appended so far, of all rule versions."""
        scan = self.spark.read.schema(self.SCHEMA)
        files = scan.option("recursiveFileLookup", "true").parquet(self.path).inputFiles()
        parts = sorted({unquote(file).rsplit("/", 1)[0] for file in files})
        return self.spark.read.schema(self.SCHEMA).parquet(*parts)

    def append(self, entries: DataFrame) -> None:
        part = f"{self.path.rstrip('/')}/part-{uuid.uuid4().hex}"
        entries.select("blob", "spans", "rule_version").write.mode("errorifexists").parquet(part)


def scan_loads(
    loads: Sequence[DataFrame],
    ledger: Ledger,
    rules: tuple[Rule, ...] = RULES,
    version: str = RULE_VERSION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Findings of the rows of all loads, which come one after the other: a text is scanned by the first load that has it."""
    found = []
    for load in loads:
        findings, entries = scan_new(load, ledger.read(), rules, version, id_col, text_col)
        ledger.append(entries)
        found.append(findings)
    return reduce(DataFrame.unionByName, found)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def digest(findings: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of their spans and the list of all spans, per row."""
    base = F.filter("spans", lambda x: x["rank"] < BASE_KINDS)
    ranks = F.transform("spans", lambda x: x["rank"])
    counts = [
        F.size(F.filter(ranks, lambda rank: rank == F.lit(k))).cast("long").alias(f"n_{rule.kind}")  # noqa: B023
        for k, rule in enumerate(RULES[:BASE_KINDS])
    ]
    return findings.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
