"""Shards of clip features as a Spark data source: ``df.write.format("shards")`` and ``spark.read.format("shards")``.

A shard is a file of frames (half precision, ``.npy``) and an index with a JSON line for each clip. Tasks write under
the name of their job. The driver's commit then writes the manifest, which names the files of that
job and is all that readers look at, so shards, indices and manifest appear together or not at all;
an aborted job removes what it wrote. Files of lost task attempts are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

WIDTH = "width"
SHARDS_PER_TASK = 8
SCHEMA = ("shard bigint, id string, client_id string, tokens string, split string, start bigint, length bigint, "
          "features array<float>")
CLIP = ["id", "client_id", "tokens", "split", "start", "length"]
_MANIFEST = "manifest.json"


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class ShardFiles(InputPartition):
    files: list[dict]


class ShardWriter(DataSourceArrowWriter):
    """Rows come in the order of (shard, start), each shard in one task."""

    def __init__(self, path: str, width: int):
        self.path, self.width, self.job = path, width, f"job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        folder = f"{root}/{self.job}"
        fs.create_dir(folder, recursive=True)
        attempt, files, clips, frames, current = uuid.uuid4().hex[:12], [], [], [], None

        def close() -> None:
            stacked = np.concatenate(frames).astype(np.float16).reshape(-1, self.width)
            name = f"shard-{current:04d}-{attempt}"
            with fs.open_output_stream(f"{folder}/{name}.npy") as out:
                np.lib.format.write_array(out, stacked, allow_pickle=False)
            with fs.open_output_stream(f"{folder}/{name}.index.jsonl") as out:
                out.write("".join(json.dumps(c) + "\n" for c in clips).encode())
            files.append({"shard": current, "name": f"{self.job}/{name}", "clips": len(clips), "frames": len(stacked)})

        for batch in iterator:
            for row in batch.select(["shard", *CLIP, "features"]).to_pylist():
                if row["shard"] != current:
                    if clips:
                        close()
                    current, clips, frames = row["shard"], [], []
                values = np.asarray(row["features"], np.float32)
                if len(values) != row["length"] * self.width:
                    raise ValueError(f"clip {row['id']} has {len(values)} values for {row['length']} frames")
                frames.append(values)
                clips.append({c: row[c] for c in CLIP})
        if clips:
            close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        fs, root = _place(self.path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["shard"])
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{self.job}.json") as out:
            out.write(json.dumps({"width": self.width, "shards": files}).encode())
        fs.move(f"{root}/{self.job}.json", f"{root}/{_MANIFEST}")

    def abort(self, messages: list[Written]) -> None:
        fs, root = _place(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ShardFiles]:
        files = manifest(self.path)["shards"]
        return [ShardFiles(files[k:k + SHARDS_PER_TASK]) for k in range(0, len(files), SHARDS_PER_TASK)] or [ShardFiles([])]

    def read(self, partition: ShardFiles) -> Iterator[tuple]:
        """Clips of shards that have both files; a shard that lacks one or has no clips is skipped."""
        fs, root = _place(self.path)
        for entry in partition.files:
            names = [f"{root}/{entry['name']}{end}" for end in (".npy", ".index.jsonl")]
            if any(i.type == pyarrow.fs.FileType.NotFound for i in fs.get_file_info(names)):
                continue
            with fs.open_input_stream(names[1]) as lines:
                clips = [json.loads(x) for x in lines.read().decode().splitlines() if x.strip()]
            if not clips:
                continue
            with fs.open_input_file(names[0]) as data:
                frames = np.lib.format.read_array(data, allow_pickle=False)
            for c in clips:
                part = frames[c["start"]:c["start"] + c["length"]]
                yield (entry["shard"], *(c[k] for k in CLIP), part.astype(np.float32).ravel().tolist())


class ShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        if not overwrite:
            raise ValueError("shards are written as a whole: use mode('overwrite')")
        return ShardWriter(self.options["path"], int(self.options[WIDTH]))


def manifest(path: str) -> dict:
    """``width`` and ``shards`` (shard, name, clips, frames) of the last committed write."""
    fs, root = _place(path)
    with fs.open_input_stream(f"{root}/{_MANIFEST}") as f:
        return json.loads(f.read())


def write_shards(df: DataFrame, path: str, width: int) -> None:
    """Write clips of :func:`phonoframe.operators.splits.shards` with their ``features`` (``length`` x ``width`` values).

    ``path`` is a folder that all executors share. A shard holds a bounded number of clips and is written by one
    task. Files of earlier writes stay, unnamed by the new manifest.
    """
    df.sparkSession.dataSource.register(ShardSource)
    rows = df.selectExpr("CAST(shard AS BIGINT) AS shard", *[f"CAST({c} AS STRING) AS {c}" for c in CLIP[:4]],
                         "CAST(start AS BIGINT) AS start", "CAST(length AS BIGINT) AS length",
                         "CAST(features AS ARRAY<FLOAT>) AS features")
    rows.repartition("shard").sortWithinPartitions("shard", "start").write.format("shards").mode("overwrite").option(
        WIDTH, width).save(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Clips with their features from the shards of the manifest that have both files."""
    spark.dataSource.register(ShardSource)
    return spark.read.format("shards").load(path)
