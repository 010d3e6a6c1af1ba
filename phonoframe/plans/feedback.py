"""Learner feedback rows and the mirror state a client shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import lookup, sigmoid

ITEM = ("struct<id:string,kind:string,severity:string,confidence:double,message_key:string,message:string,"
        "phone_index:int,start_s:double,end_s:double,contrast_index:int>")


def _slash(phone: Column) -> Column:
    return F.concat(F.lit("/"), phone, F.lit("/"))


def _item(
    id: Column, kind: str, severity: Column, confidence: Column, key: Column, message: Column,
    anchored: bool = False, evidence: bool = False,
) -> Column:
    index, start, end = F.col("phone_index"), F.col("start_s"), F.col("end_s")
    none = F.lit(None)
    return F.struct(
        id.alias("id"), F.lit(kind).alias("kind"), severity.alias("severity"),
        confidence.cast("double").alias("confidence"), key.alias("message_key"), message.alias("message"),
        (index if anchored else none).cast("int").alias("phone_index"),
        (start if anchored else none).cast("double").alias("start_s"),
        (end if anchored else none).cast("double").alias("end_s"),
        (F.lit(0) if evidence else none).cast("int").alias("contrast_index"))


def retry_item() -> Column:
    message = F.coalesce(lookup(K.RETRY, F.coalesce(F.col("reason"), F.lit(""))), F.lit(K.RETRY_DEFAULT))
    return _item(F.lit("retry"), "retry", F.lit("warning"), F.lit(1.0), F.lit("feedback.retry"), message)


def substitution_item() -> Column:
    target = _slash(F.col("target"))
    message = F.when(
        F.col("verdict") == "uncertain",
        F.concat(target, F.lit(K.SAY["hard_to_pin_down"])),
    ).otherwise(F.concat(F.lit(K.SAY["that"]), target, F.lit(K.SAY["sounded_more_like"]), _slash(F.col("detected")), F.lit(".")))
    return _item(F.lit("substitution-0"), "segmental_substitution", F.lit("warning"), F.col("confidence"),
                 F.lit("feedback.segmental_substitution"), message, anchored=True, evidence=True)


def hearing_item() -> Column:
    p = sigmoid(F.col("hearing_a") * F.col("hearing_score") + F.col("hearing_b"))
    unsure, same = p < F.col("hearing_threshold"), F.col("heard") == F.col("target")
    target = _slash(F.col("target"))
    other = F.when(F.col("heard") == "other", F.lit(K.SAY["something_else"])).otherwise(_slash(F.col("heard")))
    pick = lambda a, b, c: F.when(unsure, a).when(same, b).otherwise(c)
    key = pick(F.lit("feedback.phone_hearing_unsure"), F.lit("feedback.phone_hearing_on_target"),
               F.lit("feedback.phone_hearing_other"))
    message = pick(
        F.concat(F.lit(K.SAY["could_not_tell"]), target,
                 F.lit(K.SAY["sounded_like"])),
        F.concat(F.lit(K.SAY["heard"]), _slash(F.col("heard")), F.lit(K.SAY["on_target"])),
        F.concat(F.lit(K.SAY["heard"]), other, F.lit(K.SAY["going_for"]), target, F.lit(".")))
    severity = F.when(~unsure & same, "praise").otherwise("warning")
    item = _item(F.lit("hearing-0"), "phone_hearing", severity, F.round(p, 4), key, message, True, True)
    return F.when(p.isNotNull() & F.col("hearing_threshold").isNotNull() & F.col("heard").isNotNull(), item)


def tone_item() -> Column:
    sure = F.round(F.col("tone_confidence"), 4)
    named = lambda c: F.coalesce(lookup(K.TONE_NAMES, F.col(c)), F.col(c))
    low, match = sure < K.TONE_GATE, F.col("tone_detected") == F.col("tone_expected")
    pick = lambda a, b, c: F.when(low, a).when(match, b).otherwise(c)
    key = pick(F.lit("feedback.tone_uncertain"), F.lit("feedback.tone_match"), F.lit("feedback.tone_mismatch"))
    message = pick(
        F.lit(K.SAY["melody"]),
        F.concat(F.lit(K.SAY["ended_with"]), named("tone_expected"), F.lit(K.SAY["tone_on_target"])),
        F.concat(F.lit(K.SAY["target_is"]), named("tone_expected"), F.lit(K.SAY["but_ended_with"]),
                 named("tone_detected"), F.lit(".")))
    severity = F.when(~low & match, "praise").otherwise("warning")
    item = _item(F.lit("tone"), "intonation_tone", severity, sure, key, message)
    return F.when(F.col("tone_detected").isNotNull() & F.col("tone_expected").isNotNull(), item)


def feedback_items(include_ungated: bool = False) -> Column:
    """Ordered feedback of one analysed row: retry or judge then mirror, tone last.

    Needs alignment, reason, target, verdict, confidence, detected, heard, hearing_score,
    calibrated, hearing_a / _b / _threshold, phone_index, start_s, end_s, tone_detected,
    tone_expected and tone_confidence.
    """
    ok = F.col("alignment") == "ok"
    judged = (F.col("verdict") == "substituted") | (
        (F.col("verdict") == "uncertain") & F.lit(include_ungated))
    judge = F.when(ok & judged & F.col("calibrated"), substitution_item())
    mirror = F.when(ok & F.col("calibrated"), hearing_item())
    items = F.array(F.when(~ok, retry_item()), judge, mirror, tone_item())
    return F.array_compact(items.cast(f"array<{ITEM}>"))


def compose_feedback(df: DataFrame, keys: list[str], include_ungated: bool = False) -> DataFrame:
    """One row per feedback item with its position."""
    rows = df.select(*keys, F.posexplode(feedback_items(include_ungated)).alias("position", "_f"))
    return rows.select(*keys, "position", "_f.*")


def mirror_state(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """First anchored mirror item per analysis: slot, heard phone, on-target and unsure flags."""
    mirror = feedback.filter((F.col("kind") == "phone_hearing") & F.col("phone_index").isNotNull())
    first = mirror.groupBy(*keys).agg(
        F.min_by(F.struct("phone_index", "message_key", "message"), "position").alias("_m"))
    key = F.col("_m.message_key")
    on_target = key == "feedback.phone_hearing_on_target"
    unsure = key == "feedback.phone_hearing_unsure"
    name = F.regexp_extract("_m.message", "^I heard /([^/]+)/", 1)
    return first.select(
        *keys, "_m.phone_index", F.when(~on_target & ~unsure & (name != ""), name).alias("heard"),
        on_target.alias("on_target"), unsure.alias("unsure"))
