"""Exam decontamination with a generalised suffix automaton over the words of test items.

The items of a take manifest are exam material; transcripts that repeat them must not be trained on.
All items form one suffix automaton over word numbers. Transcripts are streamed through it in Arrow
tasks, tracking the longest match that ends at each word; matches that reach the window length (or a
whole shorter item) mark their words. Words that no item holds, and neighbours that stand together in
no item, end every match, so only runs between them are streamed. Nothing is shuffled while the items
fit one automaton. More items are a table of blocks: the transcripts are written once and streamed
through one block after another, and what the blocks find is grouped by transcript.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.operators.storage import scratch, store

WINDOW = 10
BLOCK_BYTES = 1 << 20
"""Text of items that one automaton holds; more items make more automata, of which one exists at a time."""


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty match."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.number: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        split = [text.translate(WD.PLAIN).split() for _, text in items]
        sequences = [[self.number.setdefault(w, len(self.number)) for w in words] for words in split]
        for sequence in sequences:
            last = 0
            for letter in sequence:
                last = self._extend(last, letter)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.holders: list[set[int]] = [set() for _ in self.next]
        for k, sequence in enumerate(sequences):
            state = 0
            for letter in sequence:
                state = self.next[state][letter]
                up = state
                while up > 0 and k not in self.holders[up]:
                    self.holders[up].add(k)
                    up = self.link[up]
            if 0 < len(sequence) < window:
                self.whole[state].append((len(sequence), k))
        lengths = [min(len(s), window) for s in sequences if s]
        self.least = min(lengths, default=0)
        vocabulary = sorted(self.number)
        found = WD.find(vocabulary, WD.BLANK).hash if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(found)
        self.hashes = found[order]
        self.numbers = np.array([self.number[vocabulary[i]] for i in order], np.int64)
        size = max(1, len(vocabulary))
        self.pairs = np.array(sorted({a * size + b for s in sequences for a, b in zip(s, s[1:])} | {-1}), np.int64)
        self.vocabulary = size

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, p: int, q: int, letter: int) -> int:
        """The state of the longest match through ``p`` then ``letter``, cut from ``q`` if needed."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(letter) == q:
            self.next[p][letter] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, letter: int) -> int:
        if letter in self.next[last]:
            return self._split(last, self.next[last][letter], letter)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and letter not in self.next[p]:
            self.next[p][letter] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][letter], letter)
        return state

    def _runs(self, words: WD.Words) -> list[tuple[int, int]]:
        """Ranges of words in which a match of the least length can stand."""
        if not self.least or not len(words.hash):
            return []
        at = np.searchsorted(self.hashes, words.hash)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == words.hash
        number = np.where(known, self.numbers[at], -1)
        together = known[:-1] & known[1:] & (words.row[:-1] == words.row[1:])
        pair = number[:-1] * self.vocabulary + number[1:]
        place = np.searchsorted(self.pairs, pair)
        place[place == len(self.pairs)] = 0
        together &= self.pairs[place] == pair
        starts = np.flatnonzero(known & np.append(True, ~together))
        ends = np.flatnonzero(known & np.append(~together, True)) + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist()))

    def scan(self, words: WD.Words) -> tuple[np.ndarray, list[set[int]]]:
        """Which words stand inside an occurrence, and the items that occur in each text."""
        hit = np.zeros(len(words.hash), bool)
        items: list[set[int]] = [set() for _ in range(words.rows)]
        for begin, end in self._runs(words):
            state, matched, found = 0, 0, items[int(words.row[begin])]
            for i in range(begin, end):
                letter = self.number.get(words.data[words.start[i]:words.end[i]], -1)
                while state and letter not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if letter in self.next[state]:
                    state = self.next[state][letter]
                    matched += 1
                up = state
                if matched >= self.window:
                    hit[i - self.window + 1:i + 1] = True
                    while self.length[self.link[up]] >= self.window:
                        up = self.link[up]
                    found |= self.holders[up]
                    up = self.link[up]
                while up > 0:
                    for size, k in self.whole[up]:
                        if size <= matched:
                            hit[i - size + 1:i + 1] = True
                            found.add(k)
                    up = self.link[up]
        return hit, items


def _blocks(items: DataFrame) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """The number of blocks of bounded text, and a function that reads one of them."""
    rows = items.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    count = max(1, math.ceil(total / BLOCK_BYTES))
    rows = rows.filter(F.col("text").isNotNull())
    if count > 1:
        path = scratch(items.sparkSession, "items")
        rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")).write.partitionBy("block").parquet(path)
        rows = items.sparkSession.read.schema("id string, text string, block int").parquet(path)

    def read(k: int) -> list[tuple[str, bytes]]:
        block = rows.filter(F.col("block") == k) if count > 1 else rows
        return sorted((name, text.encode()) for name, text in {(r.id, r.text) for r in block.toLocalIterator()})

    return count, read


_SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])


def _runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _find(items: list[tuple[str, bytes]], window: int):
    """Add what one block of items finds to the spans and items found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(items, window)
        for batch in batches:
            spans, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for first, texts in WD.slices(batch.column(1)):
                words = WD.find(texts, WD.PLAIN)
                hit, found = automaton.scan(words)
                counts = words.counts()
                begin = np.cumsum(counts) - counts
                all_spans, all_names = [], []
                for i in range(len(texts)):
                    mask = hit[begin[i]:begin[i] + counts[i]].copy()
                    for s in spans[first + i] or ():
                        mask[s["first"]:s["last"] + 1] = True
                    all_spans.append([{"first": a, "last": b} for a, b in _runs_of(mask)])
                    all_names.append(sorted({*(names[first + i] or ()), *(automaton.names[k] for k in found[i])}))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, len(texts)) for k in (0, 1)), pa.array(counts.astype(np.int64)),
                     pa.array(all_spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                     pa.array(all_names, pa.list_(pa.string()))],
                    names=["utterance_id", "transcript", "n_words", "spans", "item_ids"])

    return run


def _searched(texts: DataFrame) -> DataFrame:
    """The columns that ``_find`` takes, of a frame with an id and ``transcript``, nothing found yet."""
    return texts.select(
        texts.columns[0], "transcript", F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast(T.ArrayType(_SPAN)).alias("spans"), F.lit(None).cast("array<string>").alias("item_ids"))


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("utterance_id", id_type), T.StructField("transcript", T.StringType()),
                         T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
                         T.StructField("item_ids", T.ArrayType(T.StringType()))])


def _found(texts: DataFrame, count: int, read: Callable[[int], list[tuple[str, bytes]]], window: int) -> DataFrame:
    """(row, spans, item_ids) of the rows of a written table (row, transcript) that some block hits.

    One block is in the driver and in a worker at a time; spans of several blocks can overlap.
    """
    parts = []
    for k in range(count):
        hits = _searched(texts).mapInArrow(_find(read(k), window), _schema(T.LongType()))
        parts.append(store(hits.filter(F.size("spans") > 0).select(F.col("utterance_id").alias("row"), "spans", "item_ids")))
    return functools.reduce(DataFrame.union, parts).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.flatten(F.collect_list("item_ids")).alias("item_ids"))


def find_leaks(utterances: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Find the words of transcripts that stand inside a passage of a test item.

    ``utterances`` has ``utterance_id`` and ``transcript``, ``items`` (a take manifest) ``id`` and
    ``text``; other columns are ignored. Words are runs of ASCII letters and digits (A-Z lower-cased)
    and characters from U+0080 on. Every run of ``window`` item words is a window; an item of fewer
    words, but at least one, is one window.

    Returns one row per input row: ``utterance_id``, ``n_words``, ``n_hit``, ``spans`` (first and last
    word of each run of hit words, words from 0), ``item_ids`` (of the items with an occurring window,
    as sorted strings) and ``coverage`` (hit share of the words, 0 without words).

    Defined cases: a null transcript or item has no words; items without words are in no transcript;
    repeated items are one, a null item id is the empty string; repeated utterances give repeated
    rows; either table may be empty.
    """
    schema = _schema(utterances.schema["utterance_id"].dataType)
    texts = utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript"))
    count, read = _blocks(items)
    if count == 1:
        hits = _searched(texts).mapInArrow(_find(read(0), window), schema)
    else:
        texts = store(texts.withColumn("row", F.monotonically_increasing_id()))
        found = _found(texts.select("row", "transcript"), count, read, window)
        merged = texts.join(found, "row", "left").orderBy("row").select(  # in the given order, as with one block
            "utterance_id", "transcript", F.lit(0).cast("bigint").alias("n_words"), "spans", "item_ids")
        hits = merged.mapInArrow(_find([], window), schema)  # joins the spans and names of all blocks
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return hits.select("utterance_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids").withColumn(
        "coverage", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0))


def _cut(text: bytes, mask: np.ndarray, words: WD.Words, first: int, offset: int) -> bytes:
    """The text without the words of ``mask``; its words begin at word ``first``, its bytes at ``offset``."""
    out, at = [], 0
    for a, b in _runs_of(mask):
        out.append(text[at:words.start[first + a] - offset])
        at = int(words.end[first + b] - offset)
    return b"".join([*out, text[at:]])


def _clean(items: list[tuple[str, bytes]], window: int, most: float, column: int):
    """Cut the hit words out of one text column; rows covered beyond ``most`` fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(items, window)
        for batch in batches:
            for first, texts in WD.slices(batch.column(column)):
                keep = np.ones(len(texts), bool)
                changed: dict[int, bytes] = {}
                todo, turn = list(range(len(texts))), 0
                while todo:  # a cut can bring words together, so changed texts are streamed again
                    now = [changed.get(i, texts[i]) for i in todo]
                    words = WD.find(now, WD.PLAIN)
                    hit, _ = automaton.scan(words)
                    counts = words.counts()
                    begin = np.cumsum(counts) - counts
                    sizes = np.cumsum([0] + [len(t) + 1 for t in now])
                    again = []
                    for j, i in enumerate(todo):
                        mask = hit[begin[j]:begin[j] + counts[j]]
                        if not mask.any():
                            continue
                        if turn == 0 and mask.sum() > most * len(mask):
                            keep[i] = False
                            continue
                        changed[i] = _cut(now[j], mask, words, begin[j], sizes[j])
                        again.append(i)
                    todo, turn = again, turn + 1
                part = batch.slice(first, len(texts))
                if changed:
                    old = part.column(column).to_pylist()
                    new = [changed[i].decode() if i in changed else t for i, t in enumerate(old)]
                    part = part.set_column(column, part.schema.field(column), pa.array(new, pa.string()))
                yield part if keep.all() else part.filter(pa.array(keep))

    return run


def _cut_spans(most: float):
    """(row, text without its spans) of a batch (row, transcript, spans); null if covered beyond ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for first, texts in WD.slices(batch.column(1)):
                words = WD.find(texts, WD.PLAIN)
                counts = words.counts()
                begin = np.cumsum(counts) - counts
                sizes = np.cumsum([0] + [len(t) + 1 for t in texts])
                out = []
                for i, text in enumerate(texts):
                    mask = np.zeros(counts[i], bool)
                    for s in spans[first + i]:
                        mask[s["first"]:s["last"] + 1] = True
                    falls = mask.sum() > most * len(mask)
                    out.append(None if falls else _cut(text, mask, words, begin[i], sizes[i]).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(out, pa.string())], names=["row", "cut"])

    return run


def remove_leaks(
    utterances: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5
) -> DataFrame:
    """The utterances without the passages of test items.

    Runs of hit words (see ``find_leaks``) are cut from ``transcript``; a transcript with more than
    ``most_coverage`` of its words hit, by all items together, falls out as a row. Cut texts are searched
    for all items again until none occurs. All columns are kept as they are, and so is
    a transcript without a hit, null or empty ones included.
    """
    given = utterances.withColumn("transcript", F.col("transcript").cast("string"))
    names = given.columns
    plain = given.toDF(*[f"c{k}" for k in range(len(names))])  # names may clash in any way
    column = names.index("transcript")
    count, read = _blocks(items)
    if count == 1:
        return plain.mapInArrow(_clean(read(0), window, most_coverage, column), plain.schema).toDF(*names)
    table = store(plain.withColumn("row", F.monotonically_increasing_id()))
    now, most, turns = table.select("row", F.col(f"c{column}").alias("transcript")), most_coverage, []
    while True:  # a cut can bring words together, so changed texts meet all blocks again
        found = _found(now, count, read, window)
        cut = store(now.join(found, "row").select("row", "transcript", "spans").mapInArrow(
            _cut_spans(most), "row bigint, cut string"))
        if cut.isEmpty():
            break
        turns.append(cut.withColumn("turn", F.lit(len(turns))))
        now, most = cut.filter("cut IS NOT NULL").withColumnRenamed("cut", "transcript"), 1.0  # falls in the first turn only
    if not turns:
        return table.orderBy("row").drop("row").toDF(*names)
    last = functools.reduce(DataFrame.union, turns).groupBy("row").agg(F.max(F.struct("turn", "cut")).alias("last"))
    joined = table.join(last, "row", "left").filter("last IS NULL OR last.cut IS NOT NULL").orderBy("row")
    return joined.withColumn(f"c{column}", F.coalesce("last.cut", f"c{column}")).select(*plain.columns).toDF(*names)
