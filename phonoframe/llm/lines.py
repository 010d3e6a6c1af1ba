"""Line deduplication of transcripts by range-partitioned hashes and keep bitmaps.

Long lines become rows of (128-bit hash of the key, utterance, position). They are range-partitioned
by hash and utterance, so a line of very many transcripts spreads over several partitions, and sorted
within partitions by hash, utterance from the largest down, and position. Each task streams its rows:
the first utterance of a run keeps its lines, the others lose them if the run has enough utterances.
Runs that touch the edge of a partition, or are too long to wait for, are left open; their rows are
resolved by counts per key, of which there are at most two for each partition and one for each long
run. Only compressed bitmaps go back to the transcripts, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm.sizes import small_side
from phonoframe.llm.words import SPACES, slices
from phonoframe.operators.storage import settle

LEAST_CHARACTERS = 40
LEAST_UTTERANCES = 5
HELD_ROWS = 200_000
_KEYED = ["hi", "lo", "id_hash", "mark", "place", "n_lines"]


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(SPACES).lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def _keys(least: int):
    """One row for every line whose key is long enough; columns 2 and 3 come from the text's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                row, place, digest, count = [], [], [], []
                for i, text in enumerate(texts):
                    lines = split_lines(text)
                    found = [(p, key) for p, line in enumerate(lines) if _long(key := line_key(line), least)]
                    row += [first + i] * len(found)
                    count += [len(lines)] * len(found)
                    place += [p for p, _ in found]
                    digest += [xxhash.xxh3_128_digest(key) for _, key in found]
                halves = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                     batch.column(2).take(take), batch.column(3).take(take),
                     pa.array(place, pa.int32()), pa.array(count, pa.int32())],
                    names=["utterance_id", *_KEYED])

    return run


def _changes(rows: pa.Table, *names: str) -> np.ndarray:
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for name in names:
        values = rows[name].to_numpy()
        out[1:] |= values[1:] != values[:-1]
    return out


def _stream(least: int):
    """Follow sorted rows: give those that fall out, and those of open runs marked ``open``."""

    def decided(rows: pa.Table) -> pa.Table:
        starts = _changes(rows, "hi", "lo")
        run = np.cumsum(starts) - 1
        number = np.cumsum(starts | _changes(rows, "id_hash"))
        begin = number[np.flatnonzero(starts)]
        total = np.append(begin[1:], number[-1] + 1) - begin
        return rows.filter(pa.array((number > begin[run]) & (total[run] >= least)))

    def marked(rows: pa.Table, is_open: bool) -> Iterator[pa.RecordBatch]:
        yield from rows.append_column("open", pa.array(np.full(rows.num_rows, is_open))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opening = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            starts = np.flatnonzero(_changes(rows, "hi", "lo"))
            if len(starts) == 1:
                held = rows
                if rows.num_rows > HELD_ROWS:
                    yield from marked(rows, True)
                    held, opening = None, True
                continue
            done, held = rows.slice(0, starts[-1]), rows.slice(starts[-1])
            if opening:
                yield from marked(done.slice(0, starts[1]), True)
                done, opening = done.slice(starts[1]), False
            if done.num_rows:
                yield from marked(decided(done), False)
        if held is not None:
            yield from marked(held, True)

    return run


@F.pandas_udf(T.BinaryType())
def _pack(dropped: pd.Series, n_lines: pd.Series) -> pd.Series:
    def one(places, lines):
        kept = np.ones(lines, bool)
        kept[places] = False
        return zlib.compress(np.packbits(kept, bitorder="little").tobytes(), 6)

    return pd.Series([one(p, n) for p, n in zip(dropped, n_lines)], dtype=object)


def unpack_bitmap(bitmap: bytes, lines: int) -> np.ndarray:
    """Which of ``lines`` lines stay."""
    bits = np.frombuffer(zlib.decompress(bitmap), np.uint8)
    return np.unpackbits(bits, count=lines, bitorder="little").astype(bool)


def _source(utterances: DataFrame) -> DataFrame:
    text = F.col("transcript").cast("string")
    return utterances.select(
        "utterance_id", text.alias("transcript"), F.xxhash64("utterance_id").alias("id_hash"),
        F.xxhash64(text).alias("mark"))


def line_bitmaps(
    utterances: DataFrame, least_characters: int = LEAST_CHARACTERS, least_utterances: int = LEAST_UTTERANCES
) -> DataFrame:
    """Keep bitmaps of the transcripts that lose lines to repetition.

    ``utterances`` has ``utterance_id`` (any orderable type) and ``transcript``; other columns are
    ignored. Transcripts are cut at line feeds. A line's key has no ASCII white space at its ends and
    A-Z lower-cased; a key of ``least_characters`` characters or more that ``least_utterances`` or
    more utterances hold loses all its lines, except in the largest utterance_id that holds it.

    Returns ``utterance_id``, ``mark`` (xxhash64 of the transcript), ``n_lines``, ``n_dropped`` and
    ``keep_bitmap`` (a bit for each line, lowest bit first, zlib-compressed) for every transcript that
    loses a line; all others keep all lines.

    Defined cases: a null or empty transcript is one empty line; rows that repeat an utterance_id
    count as one utterance, and each keeps or loses its own lines; a null utterance_id is one
    utterance below all others; an empty table gives no bitmap.
    """
    spark = utterances.sparkSession
    id_type = utterances.schema["utterance_id"].dataType
    keyed = T.StructType([T.StructField("utterance_id", id_type)] + [
        T.StructField(name, T.IntegerType() if name in ("place", "n_lines") else T.LongType()) for name in _KEYED])
    order = ["hi", "lo", F.desc_nulls_last("utterance_id")]
    rows = (
        _source(utterances).select("utterance_id", "transcript", "id_hash", "mark")
        .mapInArrow(_keys(least_characters), keyed)
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
        .sortWithinPartitions(*order, "place")
    )
    followed = settle(rows.mapInArrow(_stream(least_utterances), T.StructType(
        [*keyed.fields, T.StructField("open", T.BooleanType())])))
    waiting = followed.filter("open")
    holders = waiting.groupBy("hi", "lo", "id_hash").agg(F.max("utterance_id").alias("utterance_id"))
    runs = holders.groupBy("hi", "lo").agg(
        F.count("*").alias("holders"), F.max("utterance_id").alias("largest")).filter(
        F.col("holders") >= least_utterances)
    resolved = waiting.join(small_side(runs), ["hi", "lo"]).filter(
        ~F.col("utterance_id").eqNullSafe(F.col("largest")))
    columns = ["utterance_id", "mark", "n_lines", "place"]
    fallen = followed.filter("NOT open").select(*columns).union(resolved.select(*columns))
    return fallen.groupBy("utterance_id", "mark", "n_lines").agg(F.collect_set("place").alias("places")).select(
        "utterance_id", "mark", "n_lines", F.size("places").alias("n_dropped"),
        _pack("places", "n_lines").alias("keep_bitmap"))


@F.pandas_udf(T.StringType())
def _kept(transcript: pd.Series, keep_bitmap: pd.Series) -> pd.Series:
    def one(text, bitmap):
        if bitmap is None or text is None:
            return text
        lines = text.split("\n")
        return "\n".join(line for line, stays in zip(lines, unpack_bitmap(bitmap, len(lines))) if stays)

    return pd.Series([one(t, b) for t, b in zip(transcript, keep_bitmap)], dtype=object)


def apply_bitmaps(utterances: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The utterances, all columns kept, with ``transcript`` reduced to the lines that stay, and
    ``n_lines`` (before) and ``n_dropped`` added in place of columns of that name."""
    given = [c for c in utterances.columns if c not in ("n_lines", "n_dropped")]
    side = small_side(settle(bitmaps)).select(
        F.col("utterance_id").alias("_id"), F.col("mark").alias("_mark"),
        F.col("n_dropped").cast("bigint").alias("_dropped"), F.col("keep_bitmap").alias("_bitmap"))
    text = F.col("transcript").cast("string")
    joined = utterances.select(*[f"`{c}`" for c in given]).join(
        side, F.col("utterance_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_mark")), "left")
    count = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    return joined.select(
        *[_kept(text, "_bitmap").alias(c) if c == "transcript" else F.col(f"`{c}`") for c in given],
        count.cast("bigint").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("bigint").alias("n_dropped"))
