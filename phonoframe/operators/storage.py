"""Cutting lineage: reliable checkpoints in the folder the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder serves a ``local`` master, whose executors live in the
    driver's process; any other master raises, because executors could not read such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="phonoframe-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write a frame as a table of the shared folder and read it again.

    For loops: a checkpoint keeps the planner's size estimate, which joins multiply in every turn
    until the number itself fills the driver; a table is as large as its files.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once so that several consumers do not recompute it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_BYTES = 4 << 20
"""Bytes of rows that go to a Python worker at a time; 10,000 documents, the default, can be 25 MB and more, of which the
executor and the worker hold several copies that they do not give back."""
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session hold about ``BATCH_BYTES``, if it names no limit of its own.

    Only the size of batches changes, no result; a longer row is a batch of its own.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
