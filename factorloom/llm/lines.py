"""Line dedup over all documents.

Lines are exploded by the hash of their normalised text (128 bits), documents are
counted per hash with map-side sums, and lines over the threshold are dropped from
all documents but the one with the largest id. What moves is hashes and positions;
a text moves once, to meet the positions it loses, and is put together again from
the lines left.

Defined cases: a null or empty text is one empty line; a document is a row,
so repeated rows count as several documents, and of rows that share the largest id
the one read last (largest tag) keeps its lines; null ids come before all others;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import ROW, SPACES, ascii_lower, tagged, whole

LEAST_CHARS = 20
LEAST_DOCS = 3


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Write each row with its lines and the (place, hashes) of those long enough to count."""
    lines = F.split(whole(F.col(text_col)), "\n", -1)
    rows = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    keys = F.filter(
        F.transform("lines", lambda x, k: F.struct(k.alias("place"), line_key(x).alias("key"))),
        lambda x: F.length(x["key"]) >= least_chars,
    )
    hashed = F.transform(
        keys,
        lambda x: F.struct(
            x["place"].alias("place"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")
        ),
    )
    return tagged(rows.withColumn("keys", hashed), "line-keys")


def repeated(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Hashes found in at least ``least_docs`` rows of ``keyed`` and the row that keeps them."""
    distinct = F.array_distinct(F.transform("keys", lambda x: F.struct(x["h1"], x["h2"])))
    last = F.max(F.struct(F.col("doc_id"), F.col(ROW)))
    return (
        rows.select("doc_id", ROW, F.explode(distinct).alias("k"))
        .groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count(F.lit(1)).alias("n_docs"), last.alias("last"))
        .where(F.col("n_docs") >= least_docs)
        .select("h1", "h2", "n_docs", F.col(f"last.{ROW}").alias("keeper"))
    )


def deduplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
) -> DataFrame:
    """Per row: ``doc_id, n_lines, n_dropped, kept`` (the text that is left)."""
    rows = keyed(docs, id_col, text_col, least_chars)
    dropped = (
        rows.select(ROW, F.explode("keys").alias("k"))
        .select(ROW, "k.*")
        .join(repeated(rows, least_docs), ["h1", "h2"])
        .where(F.col(ROW) != F.col("keeper"))
        .groupBy(ROW)
        .agg(F.sort_array(F.collect_list("place")).alias("gone"))
    )
    # set difference is one pass, whatever the number of lines that go
    survivors = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.transform(survivors, lambda k: F.get("lines", k))
    kept = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(left, "\n"))
    return rows.drop("keys").join(dropped, ROW, "left").select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def digest(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
