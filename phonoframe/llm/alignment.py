"""Alignment of two tokenizers over transcripts, and how often their tokens are linked.

An Arrow pipeline over slices of transcripts: token lists are flattened beside their parent indices, cumulative
sums of token bytes, taken off at each transcript's begin, give the byte at which a token ends, and an Acero
hash join on (transcript, end) finds the ends that both tokenizers share. These cut the tokens into groups; a
second join on the group makes the links. ``Table.group_by`` counts them for every transcript, and the
transcripts of a pair for every batch; Spark merges these partial counts.

The first tokenizer is a byte-level BPE. Where its merges stand in the order of their ids, ``tiktoken`` merges
with the ids as ranks, which is the same and several times as fast as the file's own library, which serves else.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm.words import slices
from phonoframe.operators.storage import scratch

BROADCAST_PAIRS = 1 << 19
"""Pairs (about 64 bytes each in memory) whose counts are broadcast at most."""
HOT_SHARE = 4096
"""A pair is hot if it is in more than one of so many links; there are fewer hot pairs than this."""
# Fixed value: how byte-level tokenizer files of this family separate words.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_TEXT = 1 << 17
"""Longer texts are encoded by the file's own library: ``tiktoken`` can give up on runs of a million letters."""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Tokenizers:
    """Both tokenizers of given files, and the bytes of their tokens."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_file, encoding="utf-8") as f:
            given = json.load(f)
        self.library = Tokenizer.from_file(byte_file)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = given["model"]["vocab"]
        added = {t["id"]: t["content"].encode() for t in given["added_tokens"]}
        size = max([*vocabulary.values(), *added]) + 1
        names: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            if i not in added:
                names[i] = bytes(letters[c] for c in token)
        for i, content in added.items():
            names[i] = content
        self.fast = self._ranked(given, names, added)
        self.a_bytes = pa.array(names, pa.binary())
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.pieces = pieces
        self.b_bytes = pa.array(
            [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
             else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())], pa.binary())
        self.a_text, self.b_text = (
            {end: pa.array([f"{i}{end}" for i in range(n)], pa.string()) for end in ",|;"}
            for n in (size, pieces.get_piece_size()))

    @staticmethod
    def _ranked(given: dict, names: list[bytes], added: dict):
        """A ``tiktoken`` encoding of the same results, or None if the file does not allow one."""
        model, before = given["model"], given["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        singles = sum(len(n) == 1 for n in names)
        same = (
            given["normalizer"] is None and before == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True}
            and not model.get("ignore_merges") and not model.get("dropout")
            and all(a < b for a, b in zip(order, order[1:])) and singles == 256
            and len(merges) + 256 + len(added) == len(names))
        if not same:
            return None
        import tiktoken

        ranks = {name: i for i, name in enumerate(names) if i not in added}
        return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of a text as it is; strings of special tokens are plain text."""
        if self.fast is not None and len(text) <= LONG_TEXT:
            return np.asarray(self.fast.encode_ordinary(text), np.int32)
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[pa.ListArray, pa.ListArray]:
        """Tokens of a space and each text by the first, of each text by the second tokenizer."""
        shown = [t.decode(errors="replace") for t in texts]
        a = [self.encode_a(" " + t) if t else np.zeros(0, np.int32) for t in shown]
        b = self.pieces.encode(shown, num_threads=1) if shown else []
        return _lists(a), _lists([np.asarray(ids, np.int32) for ids in b])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


@functools.lru_cache(maxsize=2)
def tokenizers(byte_file: str, piece_file: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file)


# -- one slice of texts ----------------------------------------------------------------


def _ends(ids: pa.ListArray, names: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(token, parent, byte after the token) of all tokens, counted from the begin of their text."""
    flat, parent = ids.flatten(), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.cast(pc.binary_length(pc.take(names, flat)), pa.int64()))
    before = np.append(0, upto.to_numpy())[ids.offsets.to_numpy()[:-1]]
    return flat, parent, pc.subtract(upto, pc.take(pa.array(before), parent))


def _whole(ids: pa.ListArray, names: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which texts the bytes of their tokens, joined, give back with a space before them."""
    joined = pc.take(names, ids.flatten())
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    at = joined.buffers()[1]
    ends = np.frombuffer(at, np.int32)[joined.offset:joined.offset + len(joined) + 1] if at else np.zeros(1, np.int32)
    cuts = ends[ids.offsets.to_numpy()].tolist()
    return np.array([bool(t) and data[a:b] == b" " + t for t, a, b in zip(texts, cuts[:-1], cuts[1:])], bool)


def align_slice(tokens: Tokenizers, texts: list[bytes]) -> dict[str, pa.Array]:
    """Counts, group text and links of each text."""
    rows = len(texts)
    a_ids, b_ids = tokens.encode(texts)
    whole = _whole(a_ids, tokens.a_bytes, texts) & _whole(b_ids, tokens.b_bytes, texts)
    at = np.flatnonzero(whole)
    a_ids, b_ids = (ids.filter(pa.array(whole)) for ids in (a_ids, b_ids))
    a, a_row, a_end = _ends(a_ids, tokens.a_bytes)
    b, b_row, b_end = _ends(b_ids, tokens.b_bytes)
    # the key of an end: its text in the upper, its byte in the lower half
    left = pa.table({"end": pc.add(pc.shift_left(a_row, 32), a_end), "a_at": np.arange(len(a))})
    right = pa.table({"end": pc.add(pc.shift_left(b_row, 32), b_end), "b_at": np.arange(len(b))})
    shared = left.join(right, "end", join_type="inner", use_threads=False)

    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[shared["a_at"].to_numpy()] = True
    last_b[shared["b_at"].to_numpy()] = True
    a_group, b_group = (np.cumsum(last) - last for last in (last_a, last_b))
    group_row = at[a_row.to_numpy()[last_a]]
    n_group = len(group_row)
    a_size, b_size = np.bincount(a_group, minlength=n_group), np.bincount(b_group, minlength=n_group)
    link_row, pair, link = _links(rows, group_row, (a.to_numpy(), a_group, a_size), (b.to_numpy(), b_group, b_size))
    n_pairs = np.bincount(link_row, minlength=rows)
    listed = pa.StructArray.from_arrays([pa.array(pair), pa.array(link)], ["pair", "links"])
    sums = np.zeros(rows, np.int64)
    np.add.at(sums, link_row, link)

    def per_row(parents: np.ndarray) -> np.ndarray:
        return np.bincount(parents, minlength=rows)

    return {
        "n_a": pa.array(per_row(at[a_row.to_numpy()])), "n_b": pa.array(per_row(at[b_row.to_numpy()])),
        "n_groups": pa.array(per_row(group_row)), "n_links": pa.array(sums),
        "groups": _group_text(tokens, rows, at, (a, a_row, a_group, a_size, last_a), (b, b_row, b_group, b_size, last_b)),
        "links": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_pairs)).astype(np.int32)), listed)}


def _links(rows: int, group_row: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of every pair of ids that a row links, in that order.

    Groups of one token on each side are pairs as they are; the tokens of the others are counted by group and id,
    and the counts joined on the group.
    """
    (a, a_group, a_size), (b, b_group, b_size) = left, right
    single = (a_size == 1) & (b_size == 1)
    counted = []
    for ids, group, name in ((a, a_group, "n_a"), (b, b_group, "n_b")):
        rest = ~single[group]
        key = (group[rest].astype(np.int64) << 32) | ids[rest]
        seen = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
        at = seen["key"].to_numpy()
        counted.append(pa.table({"group": at >> 32, name[-1]: at & 0xFFFFFFFF, name: seen["count_all"]}))
    met = counted[0].join(counted[1], "group", join_type="inner", use_threads=False)
    row = np.concatenate([group_row[single], group_row[met["group"].to_numpy()]])
    first = np.concatenate([a[single[a_group]], met["a"].to_numpy()]).astype(np.int64)
    second = np.concatenate([b[single[b_group]], met["b"].to_numpy()]).astype(np.int64)
    links = np.concatenate([np.ones(int(single.sum()), np.int64), pc.multiply(met["n_a"], met["n_b"]).to_numpy()])
    wide = int(second.max()) + 1 if len(second) else 1
    span = (int(first.max()) + 1) * wide if len(first) else 1
    if span.bit_length() + rows.bit_length() > 62:
        raise ValueError("a slice holds too many texts for these vocabularies")
    summed = pa.table({"key": row * span + first * wide + second, "links": links}).group_by("key", use_threads=False).aggregate(
        [("links", "sum")])
    key, total = summed["key"].to_numpy(), summed["links_sum"].to_numpy()
    order = np.argsort(key, kind="stable")
    key, total = key[order], total[order]
    pair = key % span
    return key // span, (pair // wide << 32) | pair % wide, total


def _group_text(tokens: Tokenizers, rows: int, at: np.ndarray, left: tuple, right: tuple) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for every row: ids taken with what follows them, in the order of their groups."""
    (a, a_row, a_group, a_size, last_a), (b, b_row, b_group, b_size, last_b) = left, right
    place_a = np.arange(len(a)) + (np.cumsum(b_size) - b_size)[a_group]
    place_b = np.arange(len(b)) + np.cumsum(a_size)[b_group]
    # all texts of ids stand in one array: of the first with , and |, of the second with , and ;
    names = pa.chunked_array([tokens.a_text[","], tokens.a_text["|"], tokens.b_text[","], tokens.b_text[";"]]).combine_chunks()
    n_a, n_b = len(tokens.a_text[","]), len(tokens.b_text[","])
    order = np.zeros(len(a) + len(b), np.int64)
    order[place_a] = a.to_numpy() + n_a * last_a
    order[place_b] = b.to_numpy() + 2 * n_a + n_b * last_b
    shown = pc.take(names, pa.array(order))
    ends = np.append(0, np.cumsum(pc.binary_length(shown).to_numpy(zero_copy_only=False), dtype=np.int64))
    data = memoryview(shown.buffers()[2] or b"").cast("B")
    count = np.bincount(at[a_row.to_numpy()], minlength=rows) + np.bincount(at[b_row.to_numpy()], minlength=rows)
    cuts = ends[np.append(0, np.cumsum(count))].tolist()
    return pa.array([str(data[x:y - 1], "ascii") if y > x else "" for x, y in zip(cuts[:-1], cuts[1:])], pa.large_string())


# -- Spark steps -----------------------------------------------------------------------

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _align(byte_file: str, piece_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(byte_file, piece_file)
        for batch in batches:
            for first, texts in slices(batch.column(2)):
                found = align_slice(tokens, texts)
                found["groups"] = found["groups"].cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), *found.values()],
                    names=["row", "utterance_id", *found])

    return run


def align_tokens(utterances: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """Tokens of every transcript by two tokenizers, cut where both end at the same byte.

    ``utterances`` has ``utterance_id`` and ``transcript``; other columns are ignored, whatever their names.
    ``byte_file`` is a byte-level BPE for ``tokenizers`` and reads a space and the transcript;
    ``piece_file`` is a model for ``sentencepiece`` that adds the space itself. No special tokens are added, and
    their strings in a transcript are plain text.

    Returns one row per input row, written as a table: ``row`` (a number of its own), ``utterance_id``,
    ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (pairs of tokens of one group), ``groups`` (``a1,a2|b1;a3|b2,b3``
    in ids) and ``links``, an array of (``pair``: first id * 2^32 + second id, ``links``: how often).

    Defined cases: a null or empty transcript, and one that either tokenizer does not give back byte by
    byte (such as one that holds U+2581), has no tokens: zeros, empty text and no links. Repeated and null
    ids are rows of their own; an empty table gives an empty result.
    """
    spark = utterances.sparkSession
    kind = utterances.schema["utterance_id"].dataType
    link = T.StructType([T.StructField("pair", T.LongType()), T.StructField("links", T.LongType())])
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("utterance_id", kind),
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(link))])
    given = utterances.select(
        F.monotonically_increasing_id().alias("row"), "utterance_id", F.col("transcript").cast("string").alias("transcript"))
    path = scratch(spark, "aligned")
    given.mapInArrow(_align(byte_file, piece_file), schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of a batch hold each pair; a row lists a pair once."""
    for batch in batches:
        held = pa.table({"pair": batch.column(0).flatten()})
        counted = held.group_by("pair", use_threads=False).aggregate([([], "count_all")])
        yield from counted.rename_columns(["pair", "held"]).combine_chunks().to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``held`` (the number of rows of ``aligned`` that link it) and ``best`` (no pair of the same first id
    is held by more)."""
    partial = aligned.select(F.transform("links", lambda x: x["pair"]).alias("pairs")).mapInArrow(
        _partial_counts, "pair bigint, held bigint")
    counts = partial.groupBy("pair").agg(F.sum("held").alias("held"))
    # a first id has at most as many pairs as the second vocabulary has tokens
    of_first = W.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("best", F.col("held") == F.max("held").over(of_first))


def score_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """For every ``row`` of ``aligned`` with links: ``n_best`` (links whose pair is ``best``) and ``count_sum`` (sum of
    ``held`` over links). ``counts`` is what ``pair_counts`` found for these rows.

    Up to ``broadcast_pairs`` counts are broadcast and nothing but sums of rows is shuffled. Beyond, links are
    shuffled by pair; the pairs that would fill one task are then those of more than one in ``HOT_SHARE`` links,
    of which there are less than ``HOT_SHARE``, and only these are broadcast.
    """
    links = aligned.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.links")
    size = counts.agg(F.count("*").alias("n"), F.sum("held").alias("held")).first()
    if size.n <= broadcast_pairs:
        known = links.join(F.broadcast(counts), "pair")
    else:
        hot = F.col("held") * HOT_SHARE > F.lit(size.held)
        frequent = F.broadcast(counts.filter(hot))
        known = links.join(frequent, "pair").union(
            links.join(frequent.select("pair"), "pair", "left_anti").join(counts.filter(~hot), "pair"))
    return known.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("held")).alias("count_sum"))
