"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary one only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


#: Rows of long texts that go to Python at a time.
BATCH_ROWS = 2000


def long_texts(df: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are cut down, as 10,000 long texts are too much."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


#: Most keys that are sent to every executor; beyond, both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def matching(df: DataFrame, keys: DataFrame, column: str, how: str) -> DataFrame:
    """Rows with (left_semi) or without (left_anti) one of the keys.

    The keys are written and counted first: up to BROADCAST_KEYS longs (about 16 MB) are broadcast,
    so the rows stay where they are; more are joined by shuffle. Rows with a null key have no match.
    """
    keys = written(keys.select(column).distinct(), "keys")
    few = keys.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, column, how)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write to a new shared folder and read it again: cuts lineage, outlives executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
