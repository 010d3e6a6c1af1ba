"""N-gram Jaccard join of transcripts by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. It is cut into fragments, and every
transcript's set is cut with it, so that a fragment sees a segment of each set.

1. One half of the order is counted first. An n-gram of a single set can be in no overlap, so a set
   with more such n-grams than a link allows has no partner and needs no further work. Each task
   sends two witnesses of a repeated n-gram at most and credits its other holders itself, which
   keeps n-grams of very many transcripts small before they are shuffled.
2. The sets that remain are cut into fragments of the whole order. N-grams are ranked by how many of
   these sets hold them; linked sets share one of their rarest (prefix filter).
3. Members of a posting list are paired with one hub, the set with most n-grams from this one on, and then the
   one with the largest share of its n-grams from this one on.
   Lists whose members are connected need no more pairs; in the others, members outside the largest
   component are paired with every member of another component. Both times only pairs are made that
   the rest of both sets, from this n-gram on, allows to link (positional filter; a linked pair passes
   it at its first common n-gram). In the last round, pairs whose rarer halves have too few n-grams in common
   fall out before their whole sets meet. Partial overlaps of a pair are counted in each fragment and summed.
   So no link between components is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.llm.sizes import few_files, parts, small_side
from phonoframe.operators.storage import settle, store

FRAGMENTS = 8
HUB_ROUNDS = 2
POSTINGS_PER_PIECE = 400_000
MOST_LABELS = 250_000
"""Labels of nodes that are broadcast at most; there is a new table of them in every round."""
CLASS_STEP = 1.02
"""Sizes and rests of members of one class differ by less than this factor."""
_SALT = np.uint64(0x5851F42D4C957F2D)


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, ...]:
    """(row, hash) of the shingles, and per row their count and the fingerprint of the set."""
    words = WD.find(texts, WD.BLANK)
    row, value = WD.shingles(words, n)
    size = np.bincount(row, minlength=len(texts))
    mark = WD.mix(WD.per_row(WD.mix(value ^ _SALT), row, len(texts)) + size.astype(np.uint64))
    return row, value, size, mark.view(np.int64)


def _lower_half(value: np.ndarray) -> np.ndarray:
    return value < np.uint64(1 << 63)


def _profiles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in WD.slices(batch.column(1)):
                row, value, size, mark = _sets(texts, n)
                half = np.bincount(row[_lower_half(value)], minlength=len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(size.astype(np.int64)),
                     pa.array(half.astype(np.int64)), pa.array(mark)],
                    names=["utterance_id", "n_shingles", "n_half", "node"])

    return run


def _half_postings(n: int, pieces: int):
    """Blobs of (set, n-gram) of the first half of the order, one row per piece of it and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in WD.slices(batch.column(1), 2 << 20):
                row, value, size, mark = _sets(texts, n)
                once = np.zeros(len(texts), bool)
                once[np.unique(mark, return_index=True)[1]] = True
                keep = once[row] & _lower_half(value)
                node, value = mark[row[keep]], value[keep]
                order = np.argsort(value, kind="stable")
                node, value = node[order], value[order]
                begin = np.flatnonzero(np.diff(value, prepend=~value[:1]))
                rank = np.arange(len(value)) - np.repeat(begin, np.diff(np.append(begin, len(value))))
                sent = rank < 2
                credit, credits = np.unique(node[~sent], return_counts=True)
                node, value = node[sent], value[sent]
                piece = ((value >> np.uint64(31)) * np.uint64(pieces)) >> np.uint64(32)
                cuts = np.append(np.flatnonzero(np.diff(piece.astype(np.int64), prepend=-1)), len(piece))
                out = [(int(piece[a]), node[a:b].tobytes(), value[a:b].tobytes(), b"", b"")
                       for a, b in zip(cuts[:-1], cuts[1:])]
                if len(credit):
                    out.append((int(credit[0] % pieces), b"", b"", credit.tobytes(),
                                credits.astype(np.int64).tobytes()))
                if out:
                    kinds = [pa.int32()] + [pa.binary()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                        names=["piece", "nodes", "grams", "credit", "credits"])

    return run


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _shared_counts(piece: pd.DataFrame) -> pd.DataFrame:
    """How many n-grams of a piece each set shares with another set."""
    value, node = _joined(piece.grams, np.uint64), _joined(piece.nodes, np.int64)
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (node[1:] != node[:-1])
    value, node = value[fresh], node[fresh]
    same = value[1:] == value[:-1]
    shared = np.append(same, False) | np.insert(same, 0, False) if len(value) else np.zeros(0, bool)
    found, counts = np.unique(node[shared], return_counts=True)
    return pd.DataFrame({
        "node": np.concatenate([found, _joined(piece.credit, np.int64)]),
        "shared": np.concatenate([counts.astype(np.int64), _joined(piece.credits, np.int64)])})


def _segments(n: int, fragments: int):
    """The sets of the given transcripts, cut at the fragments of the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for first, texts in WD.slices(batch.column(1)):
                row, value, size, mark = _sets(texts, n)
                same = mark == wanted[first:first + len(texts)]
                keep = same[row]
                row, value = row[keep], value[keep]
                part = ((value >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
                key = row * fragments + part.astype(np.int64)
                at = np.flatnonzero(np.diff(key, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[row[at]]), pa.array(size[row[at]].astype(np.int64)),
                     pa.array((key[at] % fragments).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.append(at, len(key)).astype(np.int32)),
                                              pa.array(value.view(np.int64)))],
                    names=["node", "n", "fragment", "grams"])

    return run


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose partial overlaps, summed over the fragments, make a link."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("bigint").alias("o"))
    )
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _able(pairs: DataFrame, starts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose starts share enough n-grams for a link.

    Common n-grams up to the end of the start that ends first are in both starts; after it, there are at most
    those that its set has left.
    """
    def side(x: str) -> DataFrame:
        return starts.select(F.col("node").alias(x), F.col("grams").alias(f"g{x}"), (F.col("common") - F.size("grams")).alias(f"left{x}"))

    most = F.size(F.array_intersect("ga", "gb")) + F.greatest("lefta", "leftb")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(
        (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for the ends of edges (a, b), a written table; the label is the smallest node of a component.

    With ``known``, the result for earlier edges, only new ones are given: they link its labels, which are
    far fewer than its nodes, and its nodes take the labels' new ones.
    """
    count = edges.count()
    if known is None:
        return _spread(edges, count)
    if not count:
        return known
    nodes = known.count()

    def side(node: str, label: str) -> DataFrame:
        return small_side(known.toDF(node, label), nodes, MOST_LABELS)

    ends = edges.join(side("a", "la"), "a", "left").join(side("b", "lb"), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = _spread(ends.filter("a <> b"), count)
    merged = known.join(small_side(moved.toDF("label", "root"), rows=MOST_LABELS), "label", "left").select(
        "node", F.coalesce("root", "label").alias("label"))
    fresh = moved.join(side("node", "label").select("node"), "node", "left_anti")
    return store(few_files(merged.union(fresh), nodes + 2 * count))


def _spread(edges: DataFrame, count: int) -> DataFrame:
    """``components`` of ``count`` edges at most.

    Each round takes the smallest label around and then that label's own label, so long paths shrink
    by a factor. State is a written table, whose size the planner knows in every round; only whether a
    label changed reaches the driver.
    """
    def pair(node: str, other: str) -> Column:
        return F.struct(F.col(node).alias("node"), F.col(other).alias("other"))

    each = F.explode(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b")))
    both = store(few_files(edges.select(each.alias("p")).select("p.*").distinct(), 4 * count))
    labels = store(few_files(both.groupBy("node").agg(F.min("other").alias("label")), 2 * count))
    nodes = labels.count()

    def side(node: str, label: str) -> DataFrame:
        return small_side(labels.toDF(node, label), nodes, MOST_LABELS)

    while True:
        near = both.join(side("other", "near"), "other").groupBy("node").agg(
            F.min("near").alias("label"), F.max(F.when(F.col("node") == F.col("other"), F.col("near"))).alias("was"))
        after = store(few_files(near.join(side("label", "root"), "label").select(
            "node", "was", F.col("root").alias("label")), nodes))
        labels = after.select("node", "label")
        if after.filter("was <> label").isEmpty():
            return labels


def reachable_pairs(members: DataFrame, percent: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, na, nb and the ``carry`` columns of both, suffixed) of members (``gram``, ``node``, ``n``, ``rest``, ``label``) of one list with different labels
    whose sizes and rests can make a link at this shingle.

    Lists are first cut into classes by size and rest; only classes that can reach each other, at their
    least size and largest rest, meet member by member.
    """
    def cell(name: str) -> Column:
        return F.floor(F.log(F.col(name).cast("double")) / math.log(CLASS_STEP)).cast("int")

    def reach(x: str, y: str) -> Column:
        return ((100 + percent) * F.least(f"rest{x}", f"rest{y}") >= percent * (F.col(f"n{x}") + F.col(f"n{y}"))) & (
            F.col(f"n{x}") * percent <= F.col(f"n{y}") * 100) & (F.col(f"n{y}") * percent <= F.col(f"n{x}") * 100)

    rows = members.withColumns({"size": cell("n"), "left": cell("rest")})
    classes = rows.groupBy("gram", "size", "left").agg(
        F.min("n").alias("n"), F.max("n").alias("most"), F.max("rest").alias("rest"),
        F.min("label").alias("low"), F.max("label").alias("high"))

    def named(frame: DataFrame, x: str, columns: list[str]) -> DataFrame:
        return frame.select("gram", *[F.col(c).alias(f"{c}{x}") for c in columns])

    columns = ["size", "left", "n", "most", "rest", "low", "high"]
    a, b = named(classes, "a", columns), named(classes, "b", columns)
    apart = (F.col("lowa") != F.col("highb")) | (F.col("lowb") != F.col("higha"))
    able = (100 + percent) * F.least("resta", "restb") >= percent * (F.col("na") + F.col("nb"))
    near = (F.col("na") * percent <= F.col("mostb") * 100) & (F.col("nb") * percent <= F.col("mosta") * 100)
    met = a.join(b, "gram").filter(able & near & apart).select("gram", "sizea", "lefta", "sizeb", "leftb")
    columns = ["size", "left", "node", "n", "rest", "label", *carry]
    pairs = (
        met.join(named(rows, "a", columns), ["gram", "sizea", "lefta"])
        .join(named(rows, "b", columns), ["gram", "sizeb", "leftb"])
        .filter((F.col("nodea") < F.col("nodeb")) & (F.col("labela") != F.col("labelb")) & reach("a", "b")))
    return pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"), "na", "nb", *[f"{c}{x}" for c in carry for x in "ab"])


def jaccard_join(utterances: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """Group utterances whose transcripts share most of their word ``n``-grams.

    ``utterances`` has ``utterance_id`` (any orderable type) and ``transcript``; other columns are
    ignored, whatever their names. Words are runs without ASCII white space, A-Z lower-cased. Two
    transcripts link when 100 * overlap >= ``percent`` * union of their distinct shingles.

    Returns one row per input row: ``utterance_id``, ``n_shingles``, ``component_id`` (the smallest
    utterance_id reachable by links, its own included).

    Defined cases: a null, empty or blank transcript has no shingles and is its own component; fewer
    than ``n`` words form one shingle; repeated rows are separate rows of one set; a null
    utterance_id takes part and is never the smallest unless all ids of its component are null; an
    empty table gives an empty result. Sets are identified by 64-bit fingerprints.
    """
    spark = utterances.sparkSession
    id_type = utterances.schema["utterance_id"].dataType
    source = utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript"))
    profile_type = T.StructType([
        T.StructField("utterance_id", id_type), T.StructField("n_shingles", T.LongType()),
        T.StructField("n_half", T.LongType()), T.StructField("node", T.LongType())])
    profiles = settle(source.mapInArrow(_profiles(n), profile_type))
    sets = profiles.filter("n_shingles > 0").groupBy("node").agg(
        F.min("utterance_id").alias("first_id"), F.max("n_shingles").alias("n"), F.max("n_half").alias("n_half"))

    half = profiles.agg(F.sum("n_half").alias("n")).first().n or 0
    blobs = source.mapInArrow(
        _half_postings(n, parts(spark, half, POSTINGS_PER_PIECE)),
        "piece int, nodes binary, grams binary, credit binary, credits binary")
    shared = blobs.groupBy("piece").applyInPandas(_shared_counts, "node bigint, shared bigint")
    alone = F.col("n_half") - F.coalesce(F.sum("shared"), F.lit(0))
    needed = F.ceil(F.col("n") * percent / 100)
    open_sets = (
        sets.join(shared, "node", "left").groupBy("node", "first_id", "n", "n_half")
        .agg(alone.alias("alone")).filter(F.col("alone") <= F.col("n") - needed)
    )
    open_sets = settle(open_sets.select("node", "first_id", "n"))

    wanted = small_side(open_sets.select(F.col("first_id").alias("_first"), F.col("node").alias("_node")))
    chosen = source.join(wanted, source.utterance_id.eqNullSafe(F.col("_first"))).select(
        "utterance_id", "transcript", "_node")
    segments = settle(chosen.mapInArrow(
        _segments(n, FRAGMENTS), "node bigint, n bigint, fragment int, grams array<bigint>"
    ).dropDuplicates(["node", "fragment"]))

    postings = segments.select("node", "n", F.explode("grams").alias("gram"))
    held = postings.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    # the common n-grams of a set from the rarest on: those that can be the first of a link, and half of all
    common = F.size("order")
    leads = common - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    starts = settle(
        postings.join(held, "gram").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("order"))
        .filter(leads > 0)
        .select("node", "n", common.alias("common"), leads.alias("leads"),
                F.slice("order", 1, F.greatest(leads, F.ceil(common / 2).cast("int")))["gram"].alias("grams")))
    prefix = starts.select(
        "node", "n", "common", F.posexplode(F.slice("grams", 1, F.col("leads"))).alias("place", "gram")
    ).select("gram", "node", "n", (F.col("common") - F.col("place")).alias("rest"))

    def close(a: str, b: str):
        return (F.greatest(a, b) * percent <= F.least(a, b) * 100)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").filter(close("na", "nb")).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
            F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()

    # at the first n-gram of a pair, its overlap is at most what either set has from there on
    reach = (100 + percent) * F.least("ra", "rb") >= percent * (F.col("na") + F.col("nb"))
    # first the largest sets, then those that share most of what they have
    best = [F.col("rest").cast("double"), F.col("rest") / F.col("n")]
    labels = None
    for turn in range(HUB_ROUNDS + 1):
        members = prefix.withColumn("label", F.col("node")) if labels is None else prefix.join(labels, "node", "left").select(
            "gram", "node", "n", "rest", F.coalesce("label", "node").alias("label"))
        if turn < HUB_ROUNDS:
            hubs = members.groupBy("gram").agg(
                F.max_by(F.struct("node", "n", "rest", "label"), F.struct(best[turn], F.xxhash64("node", F.lit(turn)))).alias("hub"),
                F.min("label").alias("low"), F.max("label").alias("high"),
            ).filter("low <> high")
            pairs = members.join(hubs, "gram").filter("label <> hub.label").select(
                F.col("node").alias("a"), F.col("hub.node").alias("b"), F.col("n").alias("na"),
                F.col("hub.n").alias("nb"), F.col("rest").alias("ra"), F.col("hub.rest").alias("rb"))
        else:
            groups = members.groupBy("gram", "label").agg(F.count("*").alias("size"))
            mixed = groups.groupBy("gram").agg(
                F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("labels")
            ).filter("labels > 1")
            inside = members.join(mixed.select("gram", "main"), "gram")
            outer = inside.filter("label <> main").select(
                "gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"),
                F.col("label").alias("la"))
            every = inside.select(
                "gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"),
                F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("is_main"))
            pairs = outer.join(every, "gram").filter("la <> lb AND (is_main OR a < b)")
        pairs = ordered(pairs.filter(reach).select("a", "b", "na", "nb"))
        if turn == HUB_ROUNDS:  # the only round whose pairs can be many more than the sets
            pairs = _able(pairs, starts, percent)
        found = _linked(pairs, segments, percent)
        labels = components(store(found), labels)

    named = sets.join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    answer = settle(named.join(groups, "label").select("node", "component_id"))
    return profiles.join(answer, "node", "left").select(
        "utterance_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("utterance_id")).alias("component_id"))


def keep_one(utterances: DataFrame, percent: int = 75, n: int = 5) -> DataFrame:
    """One utterance of each component of ``jaccard_join``, that of the smallest utterance_id.

    All columns are kept. Rows that repeat an utterance_id are one utterance and stay or go together;
    rows without an utterance_id stay. Transcripts without words stay.
    """
    found = jaccard_join(utterances, percent, n)
    repeats = settle(found.filter("utterance_id <> component_id").select(
        F.col("utterance_id").alias("_repeat")).distinct())
    return utterances.join(small_side(repeats), F.col("utterance_id") == F.col("_repeat"), "left_anti")
