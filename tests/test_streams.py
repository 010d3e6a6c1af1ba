"""Streams that are lost between write and commit, late files, state on disk."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from phonoframe.streaming import records as ST

SCHEMA = "utterance_id string, token_index int, label string"


def lose(number):
    raise RuntimeError(f"lost in batch {number}")


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / d) for d in ("source", "out", "state")]


def deliver(spark, rows, source):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)


def test_tokens_are_analysed_once_across_lost_runs(spark, places):
    source, out, state = places
    seen = []

    def analyze(work):
        seen.append(sorted(map(tuple, work.collect()), key=str))
        return work.select("utterance_id", "token_index", F.upper("label").alias("verdict"))

    def run(written=None):
        schema = spark.createDataFrame([], SCHEMA).schema
        tokens = ST.read_stream(spark, source, schema)
        ST.stream_exam(tokens, analyze, ["utterance_id", "token_index"], out, state, written).awaitTermination()

    deliver(spark, [("a", 0, "x"), ("a", 1, "x"), ("a", 1, "x")], source)
    run()
    deliver(spark, [("a", 1, "x"), ("b", 0, "y"), (None, 0, "z")], source)
    with pytest.raises(StreamingQueryException):
        run(lose)
    assert ST.exam_records(spark, out).count() >= 4
    run()
    run()
    deliver(spark, [("b", 0, "y"), ("c", 5, "y")], source)
    run()
    got = sorted(map(tuple, ST.exam_records(spark, out).collect()), key=str)
    assert got == sorted([("a", 0, "X"), ("a", 1, "X"), ("b", 0, "Y"), (None, 0, "Z"), ("c", 5, "Y")], key=str)
    # the lost batch ran twice with the same work, no other token was analysed again
    assert seen[1] == seen[2] and len(seen) == 4


def test_counters_survive_lost_runs(spark, places):
    source, out, state = places
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(written=None):
        counters = ST.stream_status(ST.read_stream(spark, source, schema), "label")
        ST.stream_counters(counters, out, state, written).awaitTermination()

    deliver(spark, [("a", 0, "ok"), ("a", 1, "failed")], source)
    run()
    deliver(spark, [("b", 0, "ok"), ("b", 1, None)], source)
    with pytest.raises(StreamingQueryException):
        run(lose)
    run()
    deliver(spark, [("c", 0, None)], source)
    run()
    assert {r.label: r.n for r in ST.read_counters(spark, out, "label").collect()} == {"ok": 2, "failed": 1, None: 2}


def test_late_files_are_kept_once_with_state_on_disk(spark, places):
    source, out, state = places
    schema = spark.range(1).schema
    held = []
    for low, high in ((0, 5_000), (3_000, 60_000), (0, 100)):
        spark.range(low, high).write.mode("append").json(source)
        once = ST.stream_dedupe(ST.read_stream(spark, source, schema), ["id"]).select("id")
        with ST.disk_state(spark):
            run = ST.stream_records(once, lambda d: d, out, state)
        run.awaitTermination()
        held.append(ST.state_size(run))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ST.ROCKSDB
    assert spark.read.parquet(out).count() == spark.read.parquet(out).distinct().count() == 60_000
    assert [h["rows"] for h in held] == [5_000, 60_000, 60_000]
    # twelve times the keys, about the same memory
    assert held[1]["bytes_in_memory"] < 3 * max(held[0]["bytes_in_memory"], 1 << 20)


def test_a_restart_copies_its_state_and_no_put_waits(spark, places, monkeypatch):
    """No log is put again, not even after a checkpoint that was written with one is resumed; buffers stay small."""
    source, out, state = places
    log = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    runs = []
    for turn in range(3):
        spark.range(turn * 1_000, turn * 1_000 + 2_000).write.mode("append").json(source)
        once = ST.stream_dedupe(ST.read_stream(spark, source, spark.range(1).schema), ["id"]).select("id")
        with monkeypatch.context() as changed:
            if not turn:
                changed.setitem(ST._STATE, log, "true")
            with ST.disk_state(spark):
                assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB") == "8"
                run = ST.stream_records(once, lambda d: d, out, state)
            run.awaitTermination()
        runs.append(run.recentProgress[-1]["stateOperators"][0])
    assert [r["numRowsTotal"] for r in runs] == [2_000, 3_000, 4_000]
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(4_000))
    assert runs[2]["customMetrics"]["rocksdbNumReplayChangelogFiles"] == 0
