"""Incremental exams: new token files are analysed once, restarts resume.

Sinks that Spark writes once for each micro-batch carry the number of the batch. A batch that was
written but not committed is run again under the same number after a restart and replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from phonoframe.operators.records import pending

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


def read_stream(
    spark: SparkSession, source: str, schema: T.StructType, fmt: str = "json", glob: str | None = None,
    files_per_trigger: int = 100,
) -> DataFrame:
    """Records as a file stream with ``seen_at``, the modification time of their file."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(source).withColumn("seen_at", F.col("_metadata.file_modification_time"))


def stream_records(
    source: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Score what arrived since the last run and append it; the checkpoint resumes."""
    return (
        score(source).writeStream.format(fmt).outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start(out)
    )


def stream_exam(
    tokens: DataFrame, analyze: Callable[[DataFrame], DataFrame], keys: list[str], out: str, checkpoint: str,
    written: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Analyse every token that arrived since the last run, each key once, and keep its record.

    ``analyze`` takes the new tokens of a micro-batch as a plain frame, so it can join whole static
    tables (posteriors, tracks, calibration), and returns records that carry ``keys``. Keys that an earlier
    batch has recorded are left out: of the recorded keys only those of this batch are compared, and
    its own records from a run that was lost before the commit are written anew. ``written`` is
    called with the number of a batch between its write and its commit.
    """

    def step(batch: DataFrame, number: int) -> None:
        work = batch.dropDuplicates(keys)
        if number:
            done = batch.sparkSession.read.parquet(out).filter(F.col("batch") < number)
            work = pending(work, done.join(work.select(*keys), keys, "left_semi"), keys)
        analyze(work).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if written is not None:
            written(number)

    return (
        tokens.writeStream.foreachBatch(step).trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )


def exam_records(spark: SparkSession, out: str) -> DataFrame:
    """Records of ``stream_exam``. While its query runs or waits for a restart, the rows of the newest batch may
    still be replaced."""
    return spark.read.parquet(out).drop("batch")


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, behind caches of bounded size.

    Runs have few, large batches, so each commits its new files: a restart copies them and does not put every key of a
    log once more. Write buffers are small, so that those of all partitions of an executor fit its bound and no put waits.
    A query takes the settings it was started with, so they are put back afterwards. All restarts of
    a checkpoint must be started in here.
    """
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key at most once, across restarts, however late or old its file is.

    State holds one entry per key and does not expire: a watermark on the file's time would drop the
    keys of older files that arrive later. It is partitioned by key over the shuffle partitions; start the
    stream in ``disk_state``, so that it grows on disk and in the checkpoint and not in memory.
    """
    return df.dropDuplicates(keys)


def state_size(run: StreamingQuery) -> dict[str, int]:
    """``rows`` and ``bytes_in_memory`` of the state of a query after its last batch."""
    operators = [o for p in run.recentProgress[-1:] for o in p["stateOperators"]]
    return {"rows": sum(o["numRowsTotal"] for o in operators),
            "bytes_in_memory": sum(o["memoryUsedBytes"] for o in operators)}


def stream_status(df: DataFrame, by: str = "alignment") -> DataFrame:
    """Running counters of processed records per status."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def stream_counters(
    counters: DataFrame, out: str, checkpoint: str, written: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Keep running counters in a table: the groups that a micro-batch changed, under its number as ``version``."""

    def step(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/version={number}")
        if written is not None:
            written(number)

    return (
        counters.writeStream.foreachBatch(step).outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )


def read_counters(spark: SparkSession, out: str, by: str = "alignment") -> DataFrame:
    """The last version of every counter of ``stream_counters``."""
    return spark.read.parquet(out).groupBy(by).agg(F.max_by("n", "version").alias("n"))
