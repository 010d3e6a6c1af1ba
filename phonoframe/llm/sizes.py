"""Choices that depend on measured sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.operators.storage import bound_batches  # noqa: F401

BROADCAST_ROWS = 1_000_000
"""Rows of a narrow frame (ids, labels, short bitmaps) that are broadcast at most."""

ROWS_PER_FILE = 100_000
"""Narrow rows that one file of a loop's table holds about at most."""


def small_side(df: DataFrame, count: int | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has at most ``rows`` rows, else as it is, so that the
    join shuffles both sides. Without its ``count``, the frame must be cheap to count: a checkpoint or a few columns."""
    return F.broadcast(df) if (df.count() if count is None else count) <= rows else df


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """The frame of ``rows`` narrow rows at most in one partition for each ``ROWS_PER_FILE`` of them, or in as many as it has
    if they are fewer: a small table of a loop is not written as one tiny file for every shuffle partition."""
    return df.coalesce(max(1, math.ceil(rows / ROWS_PER_FILE)))


def parts(spark: SparkSession, total: int, each: int) -> int:
    """How many pieces hold ``total`` entries with about ``each`` in one; at least four for every
    shuffle partition, so that hashing piece numbers to partitions stays even."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / each))
