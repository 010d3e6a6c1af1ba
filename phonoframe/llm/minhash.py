"""Near duplicates of transcripts by b-bit MinHash.

1. The set of a transcript is its distinct word shingles; equal sets are one node. ``BANDS`` x ``ROWS`` hash
   functions give the minima of a set. The minima of a band together are its bucket; of every minimum
   only the low ``BITS`` bits stay, packed as bit planes of 64 functions each.
2. Nodes of one bucket are candidates. Each is compared with one hub of its bucket only; the similarity is
   estimated by counting the functions whose planes agree and taking off the share that agrees by
   chance. Of the hubs of a node above a margin of ``SIGMAS`` standard errors below the limit, the most
   similar one is confirmed on the full sets. Buckets whose nodes are connected need no more pairs.
3. Nodes of buckets that are still mixed are searched exactly, whatever the size of the bucket: linked
   sets share one of their rarest shingles (prefix), and what both have left from there on must suffice.
   This is decided between classes of members of about equal size and rest before any pair is made,
   so members of frequent passages or templates that cannot link drop out as classes.

A link at the limit shares no bucket with probability (1 - limit^ROWS)^BANDS, 6e-11 for 0.85.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.llm.jaccard import components, reachable_pairs
from phonoframe.llm.sizes import small_side
from phonoframe.operators.storage import settle, store

ROWS, BANDS, BITS = 4, 32, 2
SIGMAS = 6.5
HUB_ROUNDS = 3
_LANES = ROWS * BANDS // 64
PLANES = [f"s{lane}_{bit}" for lane in range(_LANES) for bit in range(BITS)]
_MARK, _BAND = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


@functools.lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and an offset for each hash function."""
    seeds = WD.mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def signatures(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every band, bit planes) of sets given as rows and their hashes, both in order of rows."""
    factors, offsets = _functions()
    buckets = np.zeros((rows, BANDS), np.uint64)
    planes = np.zeros((rows, _LANES, BITS), np.uint64)
    if not len(row):
        return buckets, planes
    at = np.flatnonzero(np.diff(row, prepend=-1))
    full = row[at]
    shift = np.uint64(32)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            bucket = np.full(len(full), np.uint64(band + 1) * _BAND, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                hashes = ((value * factors[k] + offsets[k]) >> shift).astype(np.uint32)
                least = np.minimum.reduceat(hashes, at).astype(np.uint64)
                bucket = WD.mix(bucket * _MARK + least)
                for bit in range(BITS):
                    planes[full, k // 64, bit] |= ((least >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k % 64)
            buckets[full, band] = bucket
    return buckets, planes


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, ...]:
    """(row, hash) of the shingles, and per row their count and the fingerprint of the set."""
    row, value = WD.shingles(WD.find(texts, WD.BLANK), n)
    size = np.bincount(row, minlength=len(texts))
    mark = WD.mix(WD.per_row(WD.mix(value ^ _MARK), row, len(texts)) * _BAND + size.astype(np.uint64))
    return row, value, size, mark.view(np.int64)


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in WD.slices(batch.column(1)):
                row, value, size, mark = _sets(texts, n)
                buckets, planes = signatures(row, value, len(texts))
                flat = pa.array(buckets.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(size.astype(np.int64)), pa.array(mark),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), flat),
                     *[pa.array(planes[:, lane, bit].view(np.int64)) for lane in range(_LANES) for bit in range(BITS)]],
                    names=["utterance_id", "n_shingles", "node", "buckets", *PLANES])

    return run


def _wanted_sets(n: int):
    """The sets of the given transcripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in WD.slices(batch.column(0)):
                row, value, size, mark = _sets(texts, n)
                at = np.flatnonzero(np.diff(row, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[row[at]]), pa.array(size[row[at]].astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)),
                                              pa.array(value.view(np.int64)))],
                    names=["node", "n", "shingles"])

    return run


def similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Estimated Jaccard similarity of two packed signatures, less the agreements by chance."""
    agree = F.lit(0)
    for lane in range(_LANES):
        same = F.lit(-1).cast("bigint")
        for bit in range(BITS):
            name = f"s{lane}_{bit}"
            same = same.bitwiseAND(F.bitwise_not(a[name].bitwiseXOR(b[name])))
        agree = agree + F.bit_count(same)
    chance = 2.0 ** -BITS
    return (agree / F.lit(float(ROWS * BANDS)) - chance) / (1 - chance)


def margin(percent: int) -> float:
    """The least estimate that a link can have, ``SIGMAS`` standard errors below the limit."""
    chance = 2.0 ** -BITS
    agree = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * math.sqrt(agree * (1 - agree) / (ROWS * BANDS)) / (1 - chance)


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb) whose sizes and estimated similarity allow a link, with the estimate."""
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.struct(*PLANES).alias(f"s{name}"))

    known = pairs.filter("a <> b").distinct().join(side("a"), "a").join(side("b"), "b")
    planes = [{p: F.col(f"s{x}")[p] for p in PLANES} for x in "ab"]
    close = F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100
    estimated = known.filter(close).select("a", "b", "na", "nb", similarity(*planes).alias("estimate"))
    return estimated.filter(F.col("estimate") >= margin(percent))


def _nearest(pairs: DataFrame) -> DataFrame:
    """The most similar ``b`` of every ``a``."""
    best = pairs.groupBy("a").agg(F.max_by(F.struct("b", "na", "nb"), F.struct("estimate", "b")).alias("p"))
    return best.select("a", "p.*")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("bigint").alias("o"))
    return both.filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _hub_pairs(members: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """Every member of a mixed bucket with the hub of its bucket.

    The first hubs are the members with the largest buckets: a text that others were copied from shares most of
    its minima with them. Later ones are drawn; those of buckets with common members agree.
    """
    marked = _labelled(members, labels)
    drawn = F.xxhash64("node", F.lit(turn))
    hubs = marked.groupBy("bucket").agg(
        F.max_by(F.struct("node", "label"), drawn if turn else F.struct("weight", drawn)).alias("hub"),
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return marked.join(hubs.select("bucket", "hub"), "bucket").filter("label <> hub.label").select(
        F.col("node").alias("a"), F.col("hub.node").alias("b"))


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def prefixes(postings: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles of every set that one of a linked pair must share: ``gram``, ``node``, ``n`` and
    ``rest``, the number of shingles that others hold too from this one on, in order of rarity."""
    held = postings.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    per_set = W.partitionBy("node")
    return (
        postings.join(held, "gram")
        .withColumns({"rank": F.row_number().over(per_set.orderBy("df", "gram")), "common": F.count("*").over(per_set)})
        .filter(F.col("rank") <= F.col("common") - F.ceil(F.col("n") * percent / 100) + 1)
        .select("gram", "node", "n", (F.col("common") - F.col("rank") + 1).alias("rest")))


def near_duplicates(utterances: DataFrame, percent: int = 85, n: int = 5) -> DataFrame:
    """Group utterances whose transcripts share most of their word ``n``-grams.

    ``utterances`` has ``utterance_id`` (any orderable type) and ``transcript``; other columns are
    ignored, whatever their names. Words are runs without ASCII white space, A-Z lower-cased. Two
    transcripts link when 100 * overlap >= ``percent`` * union of their distinct shingles.

    Returns one row per input row: ``utterance_id``, ``n_shingles``, ``component_id`` (the smallest
    utterance_id reachable by links, its own included) and ``kept``, true for the utterance that
    stands for its component.

    Defined cases: a null, empty or blank transcript has no shingles, is its own component and kept; fewer
    than ``n`` words form one shingle; repeated rows are separate rows of one set; a null utterance_id
    takes part, is never the smallest unless all ids of its component are null, and is kept only then;
    an empty table gives an empty result. Sets are identified by 64-bit fingerprints.
    """
    id_type = utterances.schema["utterance_id"].dataType
    source = utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript"))
    profile_type = T.StructType([
        T.StructField("utterance_id", id_type), T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType())),
        *[T.StructField(p, T.LongType()) for p in PLANES]])
    profiles = store(source.mapInArrow(_profiles(n), profile_type))
    # equal sets have equal signatures, so any of them serves
    nodes = store(profiles.filter("n_shingles > 0").groupBy("node").agg(
        F.min("utterance_id").alias("first_id"), F.max("n_shingles").alias("n"),
        F.first("buckets").alias("buckets"), *[F.first(p).alias(p) for p in PLANES]))

    # two in a bucket of any band make a candidate; nodes alone in all of theirs need no further work
    spread = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    sized = store(spread.join(shared, "bucket"))
    members = store(sized.select("node", "bucket").join(sized.groupBy("node").agg(F.sum("size").alias("weight")), "node"))
    wanted = settle(members.select("node").distinct().join(nodes.select("node", "first_id"), "node").select("first_id"))
    chosen = source.join(
        small_side(wanted.withColumnRenamed("first_id", "_first")), F.col("utterance_id").eqNullSafe(F.col("_first")))
    sets = store(chosen.select("transcript").mapInArrow(
        _wanted_sets(n), "node bigint, n bigint, shingles array<bigint>").dropDuplicates(["node"]))

    labels = None
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            pairs = _nearest(_plausible(_hub_pairs(members, labels, turn), nodes, percent))
        else:
            marked = _labelled(members, labels)
            mixed = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
            open_nodes = store(marked.join(mixed.select("bucket"), "bucket").select("node", "label").distinct().join(
                nodes.select("node", F.struct(*PLANES).alias("planes")), "node"))
            postings = sets.join(open_nodes.select("node"), "node").select(
                "node", "n", F.explode("shingles").alias("gram"))
            lists = store(prefixes(postings, percent).join(open_nodes, "node"))
            several = lists.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
            met = reachable_pairs(lists.join(several.select("gram"), "gram"), percent, ("planes",))
            planes = [{p: F.col(f"planes{x}")[p] for p in PLANES} for x in "ab"]
            pairs = met.filter(similarity(*planes) >= margin(percent)).select("a", "b", "na", "nb").distinct()
        found = _confirmed(pairs, sets, percent)
        labels = components(store(found), labels)

    named = nodes.select("node", "first_id").join(labels, "node", "left").select(
        "node", "first_id", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answer = named.join(groups, "label").select("node", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("utterance_id"))
    return profiles.select("utterance_id", "n_shingles", "node").join(answer, "node", "left").select(
        "utterance_id", "n_shingles", component.alias("component_id")
    ).withColumn("kept", F.col("utterance_id").eqNullSafe(F.col("component_id")))
