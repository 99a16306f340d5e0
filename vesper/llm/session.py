"""What operators need from the session: the shared folder and how tables are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where none is set and the master is local, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vesper-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def bound_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches of at most so many bytes, where the session has no bound of its own: a worker holds a few of them, and kernels' arrays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "67108864"):  # the default
        spark.conf.set(key, size)


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there: they outlive lost executors."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
