"""Joins that build token records: targets, dimensions, resume, plans, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import col
from phonoframe.operators.splits import assign_split


def collect_tokens(
    utts: DataFrame, tokens: DataFrame, target: str, confusions: list[str], roster: DataFrame, seed: int = 42,
) -> DataFrame:
    """Every target token with the columns of its utterance, its ``split`` and the ``phones`` of its exercise.

    ``tokens`` (utterance_id, token_index, phone) are the phones of all ``utts``; only utterances that hold the target
    are joined and split. The phones of an exercise have the focus, and its confusions, on the token's own slot.
    ``roster`` is that of ``assign_split``.
    """
    own = [c for c in tokens.columns if c != "utterance_id"]
    found = F.collect_list(F.when(F.col("phone") == target, F.struct(*own)))
    holders = expected_phones(tokens, target, confusions, found.alias("_found")).filter(F.size("_found") > 0)
    joined = holders.join(assign_split(utts, roster, seed), "utterance_id")
    rest = [c for c in joined.columns if c not in ("utterance_id", "phones", "_found")]
    return joined.withColumn("_token", F.explode("_found")).select(
        "utterance_id", "_token.*", *rest, "phones").withColumn("phones", focus_on("phones", "token_index"))


def expected_phones(tokens: DataFrame, target: str, confusions: list[str], *more: Column) -> DataFrame:
    """Per utterance the ordered phone array, focus and confusions on target slots only, and ``more`` aggregates."""
    slot = F.struct(F.col("token_index").alias("index"), F.col("phone").alias("ph"))
    packed = tokens.groupBy("utterance_id").agg(F.sort_array(F.collect_list(slot)).alias("phones"), *more)
    # focus and confusions follow from the phone, so only the phone is collected and put in order
    return packed.withColumn("phones", F.transform("phones", lambda p: F.struct(
        p["index"].alias("index"), p["ph"].alias("ph"), (p["ph"] == target).alias("focus"),
        F.when(p["ph"] == target, F.array(*[F.lit(c) for c in confusions])).otherwise(
            F.array().cast("array<string>")).alias("confusions"))))


def focus_on(phones: Column | str, index: Column | str) -> Column:
    """Phone array with the focus (and its confusions) on one slot only."""
    here = lambda p: p["index"] == col(index)
    return F.transform(col(phones), lambda p: F.struct(
        p["index"].alias("index"), p["ph"].alias("ph"), here(p).alias("focus"),
        F.when(here(p), p["confusions"]).otherwise(F.array().cast("array<string>")).alias("confusions")))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not in the checkpoint yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def restrict(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was selected."""
    return df.join(keys_df.select(*keys), keys, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, strict: bool = True) -> DataFrame:
    """Attach a dimension value; an unknown key is an error when strict."""
    table = dim.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(table, F.col(key) == F.col("_key"), "left")
    found = F.col("_value")
    if strict:
        unknown = F.raise_error(F.concat(F.lit(f"unknown {key} "), F.col(key).cast("string")))
        found = F.when(F.col("_key").isNull(), unknown.cast(dim.schema[value].dataType)).otherwise(found)
    return joined.withColumn(value, found).drop("_key", "_value")


def join_aligned(tokens: DataFrame, phones: DataFrame) -> DataFrame:
    """Slot join of aligned phones to tokens; ``reason`` names tokens without a phone."""
    slots = phones.withColumn("_hit", F.lit(True))
    joined = tokens.join(slots, ["utterance_id", "token_index"], "left")
    return joined.withColumn(
        "reason", F.when(F.col("_hit").isNull(), F.lit("token not aligned"))).drop("_hit")


def plan_takes(items: DataFrame, reps: int, files: DataFrame, excluded: DataFrame) -> DataFrame:
    """Planned takes (item x repetition) with status excluded / present / missing.

    Repetitions come from a sequence, so the plan grows with the items only.
    ``files`` and ``excluded`` hold a ``take`` key "<id>_<rep>".
    """
    plan = items.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "take", F.concat_ws("_", F.col("item_id").cast("string"), F.col("rep").cast("string")))
    have = files.select(F.col("take").alias("_file")).distinct()
    drop = excluded.select(F.col("take").alias("_drop")).distinct()
    joined = plan.join(have, F.col("take") == F.col("_file"), "left").join(
        drop, F.col("take") == F.col("_drop"), "left")
    status = F.when(F.col("_drop").isNotNull(), "excluded").when(
        F.col("_file").isNotNull(), "present").otherwise("missing")
    return joined.withColumn("status", status).drop("_file", "_drop")


def check_refs(df: DataFrame) -> DataFrame:
    """(id, rule): dangling ``pair_with`` references and duplicate ids."""
    ids = df.select(F.col("id").alias("_id")).distinct()
    dangling = df.filter(F.col("pair_with").isNotNull()).join(
        ids, F.col("pair_with") == F.col("_id"), "left_anti").select(
        "id", F.lit("pair_with matches no exercise").alias("rule"))
    twice = df.groupBy("id").agg(F.count("*").alias("_n")).filter("_n > 1").select(
        "id", F.lit("duplicate id").alias("rule"))
    return dangling.unionByName(twice)


def alignment_status(
    has_speech: Column, clipping: Column, too_quiet: Column, confidence: Column,
    minimum: float | Column = K.MIN_ALIGNMENT, low: float | Column = K.LOW_ALIGNMENT,
) -> Column:
    """struct(status, reason): audio problems first, then the confidence gates."""
    problem = F.when(~has_speech, K.NO_SPEECH).when(clipping, K.CLIPPING).when(too_quiet, K.NO_SIGNAL)
    status = F.when(problem.isNotNull() | (confidence < minimum), "failed").when(
        confidence < low, "low_confidence").otherwise("ok")
    reason = F.coalesce(problem, F.when(confidence < minimum, F.lit(K.BELOW_FLOOR)))
    return F.struct(status.alias("status"), reason.alias("reason"))


def union_corpora(*frames: DataFrame) -> DataFrame:
    """One utterance table from several sources; rows with empty text are skipped."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.filter(F.trim(F.coalesce(F.col("transcript"), F.lit(""))) != "")
