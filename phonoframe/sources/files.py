"""Annotation files read line by line: a parser sees the lines of one file in their order and holds none of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from phonoframe.sources.corpora import parse_durations

BATCH_ROWS = 8192
_SIZES = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgt]?)b?\s*", text.lower()).groups()
    return int(number) * _SIZES[unit or "b"]


class Parser:
    """Reads the lines of one file. ``feed`` and ``end`` return rows of the reader's schema after ``path``."""

    def __init__(self, path: str):
        self.path = path

    def stop(self, message: str) -> None:
        raise ValueError(f"{message}: {self.path}")

    def feed(self, line: str) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def _parsed(parser: type[Parser], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: Parser | None = None
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for given in batches:
            for path, line in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                if current is None or current.path != path:
                    if current is not None:
                        rows += [(current.path, *r) for r in current.end()]
                    current = parser(path)
                for r in current.feed(line):
                    rows.append((path, *r))
                if len(rows) >= BATCH_ROWS:
                    yield batch()
        if current is not None:
            rows += [(current.path, *r) for r in current.end()]
        if rows:
            yield batch()

    return run


def read_lines(
    spark: SparkSession, paths: str | list[str], parser: type[Parser], schema: T.StructType
) -> DataFrame:
    """Rows that ``parser`` finds in the files, each file read from its first line to its last.

    Files that Spark never splits, small or gzipped ones, are parsed where they are read, many to a task and without a shuffle.
    Larger ones are read in pieces, whose lines are brought back into order by file, sorted on disk
    where they do not fit, and streamed through one task for each file.
    """
    limit = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"))
    uncut = (F.col("size") <= limit) | F.col("path").endswith(".gz")
    whole = lines.filter(uncut).select("path", "value")
    cut = lines.filter(~uncut).withColumn("at", F.monotonically_increasing_id())
    ordered = cut.repartition("path").sortWithinPartitions("path", "block", "at").select("path", "value")
    run = _parsed(parser, to_arrow_schema(schema))
    return whole.mapInArrow(run, schema).union(ordered.mapInArrow(run, schema))


# -- TextGrid ------------------------------------------------------------------------

_FIELD = re.compile(r'\s*(class|name|xmin|xmax|text) =[ \t]*"?(.*?)"?[ \t\r]*$')
_ITEM, _INTERVAL = re.compile(r"\s*item \[\d+"), re.compile(r"\s*intervals \[")


class LongTextGrid(Parser):
    """Interval tiers with one field to a line: (tier, idx, xmin, xmax, text)."""

    def __init__(self, path: str):
        super().__init__(path)
        self.first, self.marked, self.tier, self.idx = True, False, None, -1
        self.low = self.high = None

    def feed(self, line: str) -> list[tuple]:
        if self.first:
            if "ooTextFile" not in line:
                self.stop("not a long TextGrid")
            self.first = False
        self.marked = self.marked or "tiers?" in line
        field = _FIELD.match(line)
        if field is None:
            if _INTERVAL.match(line):
                self.idx, self.low, self.high = self.idx + 1, None, None
            elif _ITEM.match(line):
                self.tier, self.idx = "", -1
            return []
        key, value = field.groups()
        if key == "class" and self.tier is not None and value != "IntervalTier":
            self.stop("tier is not an IntervalTier")
        if key == "name":
            self.tier = value
        elif self.idx >= 0:
            if key == "xmin":
                self.low = value
            elif key == "xmax":
                self.high = value
            elif key == "text":
                if not self.low or not self.high:
                    self.stop("interval text before its bounds")
                return [(self.tier, self.idx, float(self.low), float(self.high), value)]
        return []

    def end(self) -> list[tuple]:
        if not self.marked:
            self.stop("no tiers? marker")
        return []


class ShortTextGrid(Parser):
    """Interval and point tiers with one value to a line: (kind, tier, idx, xmin, xmax, text)."""

    WIDTH = {"IntervalTier": ("interval", 3), "TextTier": ("point", 2)}

    def __init__(self, path: str):
        super().__init__(path)
        self.first, self.left, self.head, self.idx, self.held = True, None, [], 0, []

    def feed(self, line: str) -> list[tuple]:
        if self.first:
            if "ooTextFile short" not in line:
                self.stop("not a short TextGrid")
            self.first = False
        line = line.strip()
        if not line:
            return []
        if self.left is None:
            self.left = -1 if line == "<exists>" else None
        elif self.left == -1:
            self.left = int(line)
        elif self.left and len(self.head) < 5:
            self.head.append(line.strip('"'))
            if len(self.head) == 5:
                if self.head[0] not in self.WIDTH:
                    self.stop(f"unknown tier kind {self.head[0]}")
                self.idx, self.held = 0, []
                self._leave()
        elif self.left:
            kind, width = self.WIDTH[self.head[0]]
            self.held.append(line)
            if len(self.held) == width:
                row = (kind, self.head[1], self.idx, float(self.held[0]), float(self.held[width - 2]), self.held[-1].strip('"'))
                self.idx, self.held = self.idx + 1, []
                self._leave()
                return [row]
        return []

    def _leave(self) -> None:
        if self.idx == int(self.head[4]):
            self.head, self.left = [], self.left - 1

    def end(self) -> list[tuple]:
        if self.left is None:
            self.stop("no <exists> marker")
        if self.left or self.held:
            self.stop("the file ends inside a tier")
        return []


_BOUNDS = [T.StructField("idx", T.IntegerType()), T.StructField("xmin", T.DoubleType()),
           T.StructField("xmax", T.DoubleType()), T.StructField("text", T.StringType())]


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def read_textgrid_long(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, tier, idx, xmin, xmax, text) of long TextGrid files."""
    return read_lines(spark, paths, LongTextGrid, T.StructType([*_text("path", "tier"), *_BOUNDS]))


def read_textgrid_short(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, kind, tier, idx, xmin, xmax, text) of short TextGrid files; a point has xmin = xmax."""
    return read_lines(spark, paths, ShortTextGrid, T.StructType([*_text("path", "kind", "tier"), *_BOUNDS]))


# -- durations -------------------------------------------------------------------------


class Numbered(Parser):
    """Lines that are not blank, with their number in the file: (n, value)."""

    def __init__(self, path: str):
        super().__init__(path)
        self.n = -1

    def feed(self, line: str) -> list[tuple]:
        self.n += 1
        return [(self.n, line)] if line.strip() else []


def read_durations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, passage, duration, ord) of duration files, ``ord`` being the number of the line in its file."""
    schema = T.StructType([*_text("path"), T.StructField("n", T.LongType()), *_text("value")])
    return parse_durations(read_lines(spark, paths, Numbered, schema), F.col("n"), ["path"])
