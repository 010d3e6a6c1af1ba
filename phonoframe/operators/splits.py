"""Leakage-free splits, samples, caps and selections, all keyed by stable hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonoframe.functions.scalar import col, count_if, hash_bucket, hash_order, sigmoid
from phonoframe.operators.metrics import flagged_at, is_positive, realized_of
from phonoframe.operators.ranks import join_keys, row_index, running, top_k
from phonoframe.operators.storage import settle


MOST_SPEAKERS = 1_000_000
"""Speakers of a roster that is broadcast; a longer one is joined by a shuffle."""


def _bucket(seed: int, name: str, key: Column | str) -> Column:
    return hash_bucket(F.concat_ws(":", F.lit(str(seed)), F.lit(name), col(key).cast("string")))


def assign_split(df: DataFrame, roster: DataFrame, seed: int = 42, native: str = "native") -> DataFrame:
    """Add ``split``: native test partitions stay, other corpora are speaker-disjoint.

    Needs corpus, native_split, utterance_id, speaker and l1. ``roster`` (speaker, l1) lists the
    speakers of all corpora, so a part of the rows gets the splits of the whole. The first speaker of
    each l1 (in hash order) is test, the second is cal, all others are train. Utterances whose speaker
    and l1 are not on the roster fall back to a 30 % test bucket.
    """
    speakers = roster.filter("speaker IS NOT NULL AND l1 IS NOT NULL").select("l1", "speaker").distinct()
    order = W.partitionBy("l1").orderBy(hash_order(f"{seed}:l1", "l1", "speaker"))
    places = settle(speakers.select(
        F.col("l1").alias("_l1"), F.col("speaker").alias("_speaker"), F.row_number().over(order).alias("_rank")))
    if places.count() <= MOST_SPEAKERS:
        places = F.broadcast(places)
    joined = df.join(places, (F.col("l1") == F.col("_l1")) & (F.col("speaker") == F.col("_speaker")), "left")
    known = F.col("_rank").isNotNull()
    by_speaker = F.when(F.col("_rank") == 1, "test").when(F.col("_rank") == 2, "cal").otherwise("train")
    carved = F.when(F.col("native_split") == "test", "test").when(
        _bucket(seed, "cal", "utterance_id") < 25, "cal").otherwise("train")
    fallback = F.when(_bucket(seed, "any", "utterance_id") < 30, "test").otherwise("train")
    split = F.when(F.col("corpus") == native, carved).when(known, by_speaker).otherwise(fallback)
    return joined.withColumn("split", split).drop("_rank", "_l1", "_speaker")


def split_blocks(df: DataFrame, seed: int = 42, block: str = "block") -> DataFrame:
    """Block -> split: of the hash-ordered blocks a fifth is test, the next fifth cal.

    Blocks are recordings, so the distinct list is a small dimension; it is ordered on
    the pre-aggregated block keys, never on rows.
    """
    blocks = df.select(block).distinct()
    order = hash_order(f"{seed}:blocks", block)
    ranked = row_index(
        blocks.withColumn("_h", order), [], ["_h"], F.substring("_h", 1, 2), "_rank")
    n = blocks.agg(F.greatest(F.lit(1), F.expr("count(*) div 5")).alias("_fifth"))
    sized = ranked.crossJoin(F.broadcast(n))
    return sized.select(
        block,
        F.when(F.col("_rank") <= F.col("_fifth"), "test")
        .when(F.col("_rank") <= 2 * F.col("_fifth"), "cal")
        .otherwise("train").alias("split"),
    )


def val_flag(key: Column | str, seed: int = 42, percent: int = 15) -> Column:
    """Whole-utterance validation flag."""
    return _bucket(seed, "val", key) < percent


def leakage(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one split; empty when the split is sound."""
    spans = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split"))
    return spans.filter(F.col("first_split") != F.col("last_split"))


# -- samples and caps ------------------------------------------------------------------


def hard_negatives(df: DataFrame, k: int, l1: str | None = None) -> DataFrame:
    """Top-k correct train rows by score; the limit is taken per task first."""
    pool = df.filter((F.col("split") == "train") & (F.col("label") == "correct")
                     & F.col("score").isNotNull())
    if l1 is not None:
        pool = pool.filter(F.col("l1") == l1)
    return pool.orderBy(F.col("score").desc(), "utterance_id", "token_index").limit(k)


def _first_then_fill(first: DataFrame, fill: DataFrame, cap: int, whole: int) -> DataFrame:
    """Up to ``cap`` rows of ``first`` in order, then ``fill`` up to ``whole`` rows."""
    head = first.limit(cap).withColumn("_tier", F.lit(0)).withColumn("_place", F.lit(""))
    tail = fill.limit(whole).withColumn("_tier", F.lit(1))
    both = head.unionByName(tail)
    return both.orderBy("_tier", "_place", "utterance_id", "token_index").limit(whole).drop(
        "_tier", "_place")


def flagged_sample(
    df: DataFrame, a: float, b: float, threshold: float, seed: int = 42, value: str = "score"
) -> DataFrame:
    """Review list: the first 15 false positives, then hash-ordered true ones up to 30."""
    flagged = df.filter(flagged_at(value, a, b, threshold))
    order = ["utterance_id", "token_index"]
    false = flagged.filter(~is_positive()).orderBy(*order)
    true = flagged.filter(is_positive()).withColumn(
        "_place", hash_order(seed, *order)).orderBy("_place", *order)
    rows = _first_then_fill(false, true, 15, 30)
    return rows.select(
        *order, "l1", "start_s", "end_s",
        F.col("label").alias("corpus_label"),
        F.col("best_confusion").alias("predicted_confusion"),
        F.round(sigmoid(F.lit(a) * F.col(value) + F.lit(b)), 4).alias("p_substituted"),
        is_positive().alias("correct_flag"),
    )


def hearing_sample(
    df: DataFrame, target: str, a: float, b: float, threshold: float, seed: int = 42
) -> DataFrame:
    """Mirror review list: 15 mishearings first, then hash-ordered correct reports."""
    sure = df.filter(flagged_at("hearing_score", a, b, threshold)).withColumn(
        "realized", realized_of(target))
    order = ["utterance_id", "token_index"]
    wrong = sure.filter(F.col("heard") != F.col("realized")).orderBy(*order)
    right = sure.filter(F.col("heard") == F.col("realized")).withColumn(
        "_place", hash_order(seed, *order)).orderBy("_place", *order)
    rows = _first_then_fill(wrong, right, 15, 30)
    return rows.select(
        *order, "l1", "heard", "realized",
        F.round(sigmoid(F.lit(a) * F.col("hearing_score") + F.lit(b)), 4).alias("p_heard_realized"),
        (F.col("heard") == F.col("realized")).alias("correct_report"),
    )


def _first_by_hash(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    """The first ``n`` rows of every group in the order of ``_h`` (hexadecimal) and ``order``, found by counting.

    Rows are counted by hash prefix, first of 3 and then, where the n-th one lies, of 6 digits. All rows
    below that prefix are kept by a filter; only those that share it are put in order.
    """
    if n <= 0:
        return df.filter(F.lit(False))

    def nth(rows: DataFrame, width: int, need: Column) -> DataFrame:
        counts = rows.groupBy(*by, F.substring("_h", 1, width).alias("_cut")).agg(
            F.count("*").alias("_c"), F.max(need).alias("_need"))
        w = W.partitionBy(*by).orderBy("_cut").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counts.withColumn("_upto", F.sum("_c").over(w))
        return placed.filter("_upto >= _need AND _upto - _c < _need").select(
            *by, "_cut", (F.col("_need") - F.col("_upto") + F.col("_c")).alias("_left"))

    coarse = nth(df, 3, F.lit(n).cast("bigint"))
    inside = join_keys(df.select(*by, "_h"), coarse, by).filter(F.substring("_h", 1, 3) == F.col("_cut"))
    fine = settle(nth(inside.withColumnRenamed("_cut", "_above"), 6, F.col("_left")))
    marked = join_keys(df, fine, by, "left") if by else df.join(F.broadcast(fine), F.lit(True), "left")
    place = F.substring("_h", 1, 6)
    below = marked.filter(F.col("_cut").isNull() | (place < F.col("_cut")))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_h", *order))
    edge = marked.filter(place == F.col("_cut")).withColumn("_rank", rank).filter("_rank <= _left").drop("_rank")
    return below.unionByName(edge).drop("_cut", "_left")


def cap_per_class(
    df: DataFrame, n: int, label: str, exempt: Column, keys: list[str], seed: int = 42
) -> DataFrame:
    """At most n rows per class in hash order; exempt rows are never capped.

    The n-th hash of a class is found by counts, so rows are neither shuffled nor sorted, whatever share
    of the data a class holds.
    """
    marked = df.withColumn("_exempt", F.coalesce(exempt, F.lit(False)))
    pool = marked.filter(~F.col("_exempt")).withColumn("_h", hash_order(f"{seed}:cap", *keys))
    kept = _first_by_hash(pool, n, [label], keys).drop("_h")
    return marked.filter("_exempt").unionByName(kept).drop("_exempt")


def cap_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A reproducible random subset of n rows."""
    return _first_by_hash(df.withColumn("_h", hash_order(seed, *keys)), n, [], keys).drop("_h")


def limit_utterances(df: DataFrame, n: int) -> DataFrame:
    """Smoke subset: the first token of each of the first n utterances."""
    others = [c for c in df.columns if c not in ("utterance_id", "token_index")]
    first = df.groupBy("utterance_id").agg(
        F.min(F.struct("token_index", *others)).alias("_t"))
    return first.select("utterance_id", "_t.*").orderBy("utterance_id").limit(n)


def budget_select(
    df: DataFrame, order: str, duration: str, budget: float, cap: int | None, bucket: Column,
    low: float = 1.0, high: float = 30.0,
) -> DataFrame:
    """Take clips in order until their summed duration reaches the budget.

    ``bucket``, a whole number that never decreases along ``order``, cuts the clips into parts; only the part in which
    the budget ends is put in order, the parts before it are kept by a filter. Only clips inside [low, high] count; the clip that crosses the budget is kept.
    """
    usable = df.filter(F.col(duration).between(low, high)).withColumn("_bucket", bucket)
    sizes = usable.groupBy("_bucket").agg(F.sum(duration).alias("_d"), F.count("*").alias("_n"))
    before = running(
        sizes.withColumn("_part", F.col("_bucket")), [], ["_part"], {"_sum": F.col("_d"), "_rows": F.col("_n")},
        F.expr("_part div 4096")).withColumnRenamed("_part", "_bucket")
    most = F.lit(cap if cap is not None else (1 << 62))
    # the first bucket in which the budget or the number of clips is reached
    full = (F.col("_sum") >= budget) | (F.col("_rows") >= most)
    last = settle(before.filter(full).agg(F.min_by(
        F.struct("_bucket", (F.col("_sum") - F.col("_d")).alias("_spent"), (F.col("_rows") - F.col("_n")).alias("_count")),
        "_bucket").alias("_last")))
    rows = usable.crossJoin(F.broadcast(last))
    whole = rows.filter(F.col("_last").isNull() | (F.col("_bucket") < F.col("_last._bucket"))).drop("_last")
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = rows.filter(F.col("_bucket") == F.col("_last._bucket")).withColumns({
        "_upto": F.col("_last._spent") + F.sum(duration).over(w), "_rank": F.col("_last._count") + F.row_number().over(W.orderBy(order))})
    kept = edge.filter((F.col("_upto") - F.col(duration) < budget) & (F.col("_rank") <= most)).drop("_upto", "_rank", "_last")
    return whole.unionByName(kept).drop("_bucket")


def repeat_rows(df: DataFrame, condition: Column, times: int) -> DataFrame:
    """Rows that meet the condition occur ``times`` times."""
    copies = F.when(F.coalesce(condition, F.lit(False)), F.lit(times)).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def balanced_batches(
    df: DataFrame, label: str, keys: list[str], batch: int, seed: int = 42
) -> DataFrame:
    """Class-balanced batches: (batch, class, slot) -> row.

    There are ceil(rows / batch) batches and every class present gets the same number
    of slots in each. Slot s of a class takes row s modulo the class size of its
    hash-ordered rows, so small classes are reused. Each row finds its own slots:
    no row is ever paired with slots that are not its own.
    """
    pool = df.withColumn("_h", hash_order(f"{seed}:batches", *keys))
    ranked = row_index(pool, [label], ["_h", *keys], F.substring("_h", 1, 3), "_i")
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    whole = sizes.agg(
        F.expr(f"(sum(_size) + {batch} - 1) div {batch}").alias("_batches"),
        F.greatest(F.lit(1), F.floor(F.lit(batch) / F.count("*"))).cast("bigint").alias("_share"),
        F.count("*").alias("_classes"),
    )
    rows = join_keys(ranked, sizes, [label]).crossJoin(F.broadcast(whole))
    slots = F.col("_batches") * F.col("_share")
    first = F.col("_i") - 1
    mine = F.when(first < slots, F.sequence(first, slots - 1, F.col("_size")))
    spread = rows.withColumn("_slot", F.explode(mine))
    return spread.select(
        (F.expr("_slot div _share") + 1).alias("batch"), label,
        (F.col("_slot") % F.col("_share") + 1).alias("slot"), *[k for k in keys if k != label],
    )


def class_weights(df: DataFrame, label: str, classes: list[str], boost: float = 1.0) -> DataFrame:
    """Inverse-frequency weights total / (k * count); the first class is boosted."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_total"))
    k = len(classes)
    first = F.when(F.col(label) == classes[0], F.lit(boost)).otherwise(F.lit(1.0))
    return counts.crossJoin(F.broadcast(whole)).select(
        label, "n",
        F.round(F.col("_total") / (F.lit(float(k)) * F.col("n")) * first, 6).alias("weight"))


def export_rows(df: DataFrame, alphabet: list[str], drilled: list[str], seed: int = 42) -> DataFrame:
    """Training rows of the exam's train split, with their class and a train or val ``split``.

    ``df`` carries the exam's ``split``; its cal and test utterances are held out, so nothing that is
    examined is trained on. Closed alphabets take the tokens of their own phones, open ones those of
    the ``drilled`` phones and of the sources of ``other``. ``class`` is null on rows to skip.
    """
    from phonoframe import tables as K

    targets = [*drilled, *K.OTHER_SOURCES] if "other" in alphabet else alphabet
    rows = df.filter((F.col("split") == "train") & F.col("phone").isin(targets))
    return rows.withColumns({
        "class": class_label(alphabet),
        "split": F.when(val_flag("utterance_id", seed), "val").otherwise("train")})


def export_counts(df: DataFrame, alphabet: list[str]) -> DataFrame:
    """(kind, name, n): rows per class (zeros kept), per split and per skip reason."""
    spark = df.sparkSession
    kept, skipped = F.col("class").isNotNull(), F.col("class").isNull()
    reason = F.when(F.col("label") != "substituted", F.col("label")).otherwise(
        F.concat(F.lit("realized /"), F.coalesce(F.col("substituted_with"), F.lit("None")), F.lit("/")))
    tags = F.array_compact(F.array(
        F.when(kept, F.struct(F.lit("class").alias("kind"), F.col("class").alias("name"))),
        F.when(kept, F.struct(F.lit("split").alias("kind"), F.col("split").alias("name"))),
        F.when(skipped, F.struct(F.lit("skipped").alias("kind"), reason.alias("name"))),
    ))
    counts = df.select(F.explode(tags).alias("t")).groupBy("t.kind", "t.name").agg(
        F.count("*").alias("n"))
    zeros = spark.range(1).select(
        F.lit("class").alias("kind"),
        F.explode(F.array(*[F.lit(c) for c in alphabet])).alias("name"),
        F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(zeros).groupBy("kind", "name").agg(F.sum("n").alias("n"))


def class_label(alphabet: list[str]) -> Column:
    """Training class of a token; null when it must be skipped."""
    from phonoframe import tables as K

    open_set = "other" in alphabet
    said = F.col("substituted_with")
    fold = lambda fits: F.when(fits, F.lit("other")) if open_set else F.lit(None).cast("string")
    correct = F.when(F.col("phone").isin(*alphabet), F.col("phone")).otherwise(
        fold(F.col("phone").isin(*K.OTHER_SOURCES)))
    swapped = F.when(said.isin(*alphabet), said).otherwise(fold(said.isNotNull() & (said != "")))
    return F.when(F.col("label") == "correct", correct).when(
        (F.col("label") == "substituted") & (F.col("phone") == "ð"), swapped)


def shards(
    df: DataFrame, order: list[str], length: Column, per_shard: int, bucket: Column
) -> DataFrame:
    """Pack clips into shards of at most ``per_shard`` with row offsets inside each shard.

    A shard holds a bounded number of clips, so the offset window is bounded too.
    """
    ranked = row_index(df, [], order, bucket, "_rank").withColumn("length", length)
    numbered = ranked.withColumn("shard", F.expr(f"(_rank - 1) div {per_shard}"))
    prior = W.partitionBy("shard").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)
    return numbered.withColumn(
        "start", F.coalesce(F.sum("length").over(prior), F.lit(0))).drop("_rank")


def ctc_valid(length: Column | str, tokens: Column | str) -> Column:
    """A clip is trainable when it has frames and fewer tokens than frames."""
    words = F.filter(F.split(col(tokens), r"\s+"), lambda t: t != "")
    return (col(length) > 0) & (F.size(words) < col(length))


def prep_summary(df: DataFrame, duration: str, usable: Column, known: Column) -> DataFrame:
    """Hours and clips kept, rows seen, rows skipped for unknown words."""
    kept = usable & known
    return df.agg(
        F.round(F.sum(F.when(kept, F.col(duration)).otherwise(0.0)) / 3600, 2).alias("hours"),
        count_if(kept).alias("clips"),
        count_if(usable & ~known).alias("skipped"),
        F.count("*").alias("seen"),
    )


def slice_bounds(
    df: DataFrame, pad: float, duration: Column | str, onset: Column | str | None = None,
    rate: int = 16_000, shortest: float = 0.03,
) -> DataFrame:
    """Sample range of each token: padded, clipped, with a reason when unusable.

    With an onset the first token of an utterance starts no later than the speech does.
    """
    at = lambda t: F.floor(t * F.lit(float(rate)))
    start = at(F.col("start_s") - pad)
    if onset is not None:
        anchored = F.least(at(col(onset)), start)
        start = F.when(F.col("token_index") == 0, anchored).otherwise(start)
    first = F.greatest(F.lit(0), start)
    last = F.least(at(col(duration)), at(F.col("end_s") + pad))
    size = last - first
    reason = F.when(size <= 0, "empty interval").when(size < int(shortest * rate), "too short")
    return df.withColumns({"first_sample": first, "last_sample": last, "reject_reason": reason})
