"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "factorloom", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders that ``stage`` has written inside the innermost ``stage_alone``.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: a
    machine-local path is useless to the other hosts of a cluster.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="factorloom-checkpoint-"))
    return root or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    The result survives lost executors and keeps its partitions and row order.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/factorloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and scan it from there.

    Unlike a checkpoint the scan is columnar, so later jobs read only the
    columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks: a small file of many rows is otherwise read, and worked on, by one task.

    Adaptive execution makes one task per core of them, and fewer where there are few rows.
    """
    return df.hint("rebalance")


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stage`` what ``make`` returns, then remove all tables staged on the way to it.

    They are removed only once the result is written whole; a run that fails keeps them. Tables that
    ``make`` staged must not be used for anything else.
    """
    outer = _MADE.get()
    made: list[str] = []
    token = _MADE.set(made)
    try:
        result = stage(make(), name)
    finally:
        _MADE.reset(token)
    *passing, kept = made
    for path in passing:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if outer is not None:
        outer.append(kept)
    return result
