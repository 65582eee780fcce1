"""Text classes, row keys and staging shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.session import stage

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: An Arrow batch holds this many rows, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 256

ROW = "_row"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    plain = F.lower(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(plain)


def whole(text: Column) -> Column:
    """The text as a string, null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    inner = F.btrim(whole(text), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE_RUN, -1))).cast("long")


def tagged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once with a row tag that stays the same for every later reader."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def in_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
