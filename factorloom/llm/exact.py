"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its own content says so: behind a pair of
characters of two classes, no sooner than ``LEAST`` and no later than ``MOST``
characters after the last cut. Equal passages are thus cut alike wherever they
stand. A chunk is known by a 64-bit hash, which becomes a verified identifier by
its rank among the SHA-256 digests that share the hash (nearly always 1). A
document is the ordered list of its chunk identifiers, its recipe, and documents
are equal when their recipes are. Texts are read once and never shuffled: only
identifiers, about a fiftieth of the text, move.

Defined cases: a null text is the empty text, whose recipe is the empty list; of
equal texts the row with the smallest id stays, null ids last, and of repeated
rows with that id exactly one; an empty table gives no row; other columns are
kept or ignored as each function states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import ROW, tagged, whole

LEAST = 512
MOST = 8192

#: A cut is allowed behind a character of the first class that follows one of the second.
_BEHIND = r"[aeiortd]"
_AHEAD = r"[ \p{Ll}]"


def normalized(text: Column) -> Column:
    """Each white-space run as one space; runs that are one space already are not touched."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunk_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Chunks of ``least`` to ``most`` characters, the last one shorter."""
    return rf"(?s)(.{{{least},{most}}}?(?<={_AHEAD}{_BEHIND}[sn] )|.{{1,{most}}})"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The content-defined chunks of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), 1)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Write, per row: tag, id, digest of the whole normalised text and (hash, digest) of each chunk.

    ``keep`` names further columns to store beside them.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("_text"), *(F.col(c) for c in keep or [])
    )
    hashed = F.transform(
        chunks(F.col("_text")),
        lambda c: F.struct(F.xxhash64(c).alias("hash"), F.unhex(F.sha2(c, 256)).alias("digest")),
    )
    return tagged(
        rows.select("doc_id", *(keep or []), F.sha2("_text", 256).alias("text_sha256"), hashed.alias("chunks")),
        "exact-chunks",
    )


def chunk_identifiers(rows: DataFrame) -> DataFrame:
    """Every distinct chunk with its verified identifier (hash, rank) and number of uses."""
    uses = (
        rows.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.hash").alias("hash"), F.col("c.digest").alias("digest"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    # digests that share a 64-bit hash are next to none, whatever the number of uses
    sharing = uses.groupBy("hash").agg(F.sort_array(F.collect_set("digest")).alias("digests"))
    return sharing.select("hash", F.posexplode("digests").alias("rank", "digest")).join(uses, ["hash", "digest"])


def recipes(rows: DataFrame) -> DataFrame:
    """The ordered list of verified chunk identifiers of every row."""
    uses = rows.select(ROW, F.posexplode("chunks").alias("place", "c"))
    shared = (
        rows.select(F.explode("chunks").alias("c"))
        .select(F.col("c.hash").alias("hash"), F.col("c.digest").alias("digest"))
        .distinct()
        .groupBy("hash")
        .agg(F.sort_array(F.collect_list("digest")).alias("digests"))
        .where(F.size("digests") > 1)
    )
    # a hash with one digest is its own identifier; only the others need their rank
    clashing = (
        uses.join(shared, uses["c.hash"] == shared["hash"])
        .groupBy(ROW)
        .agg(F.collect_list(F.struct("place", (F.array_position("digests", F.col("c.digest")) - 1).alias("rank"))).alias("ranks"))
    )
    plain = F.transform("chunks", lambda c: c["hash"])
    return rows.join(clashing, ROW, "left").select(
        ROW,
        "doc_id",
        "text_sha256",
        plain.alias("recipe"),
        F.coalesce(F.sort_array("ranks"), F.array().cast("array<struct<place:int,rank:bigint>>")).alias("ranks"),
    )


def classes(rows: DataFrame) -> DataFrame:
    """Every row of ``chunked`` with the row that stays of its class.

    ``_row, doc_id, text_sha256, keep_id, group_size, kept``. Classes are formed
    with map-side sums, so a class with a third of all rows is one small row.
    """
    listed = recipes(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col(ROW).alias("row")))
    groups = listed.groupBy("recipe", "ranks").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    several = groups.where("group_size > 1")
    return listed.join(several, ["recipe", "ranks"], "left").select(
        ROW,
        "doc_id",
        "text_sha256",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col(ROW), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that repeat another one's text, with all their columns."""
    whole_row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_whole"))
    rows = chunked(
        whole_row.select("_whole", F.col(f"_whole.{id_col}").alias(id_col), F.col(f"_whole.{text_col}").alias(text_col)),
        id_col,
        text_col,
        keep=["_whole"],
    )
    dropped = classes(rows.drop("_whole")).where(~F.col("kept")).select(ROW)
    return rows.join(dropped, ROW, "left_anti").select("_whole.*")
