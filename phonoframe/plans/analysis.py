"""Batch analysis: posteriors, contours and a calibration become nested result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import let, lookup, mean, raw_score
from phonoframe.operators import posteriors as P
from phonoframe.operators.calibrate import decide, match_calibration, phone_score
from phonoframe.operators.contour import nuclear_tone
from phonoframe.operators.records import alignment_status
from phonoframe.plans.feedback import feedback_items


def analyze(
    takes: DataFrame, tracks: DataFrame, calib: DataFrame, names: dict[int, str], blank: int = 0,
    include_ungated: bool = False,
) -> DataFrame:
    """One nested result per take.

    ``takes``: take, model_id, text, logits, targets (tokens), focus (index), confusions
    (tokens), hop_s, offset_s, duration_s, has_speech, clipping, too_quiet,
    expected_tone. ``tracks``: frame rows (clip = take, i, t, st). ``calib``: one row per
    model and target with platt, threshold, gop and hearing columns. Everything but the
    two joins is a projection over one row.
    """
    token = lambda c: lookup(names, c)
    frames = takes.withColumn("frames", P.log_softmax("logits"))
    problem = P.align_problem(F.col("frames"), F.col("targets"))
    usable = F.col("has_speech") & ~F.col("clipping") & ~F.col("too_quiet")
    pathed = frames.withColumn("problem", problem).withColumn("path", F.when(
        usable & F.col("problem").isNull(), P.forced_align(F.col("frames"), F.col("targets"), blank)))
    segments = pathed.withColumn(
        "segments", F.when(F.col("path").isNotNull(), P.phone_segments(F.col("path"), F.size("targets"))))
    at = lambda f: P.clip_time(f, F.col("hop_s"), F.col("offset_s"), F.col("duration_s"))
    measured = F.transform("segments", lambda s: let(
        P.gop(F.col("frames"), s["frames"], F.get(F.col("targets"), s["index"])), lambda g: F.struct(
            s["index"].alias("index"), token(F.get(F.col("targets"), s["index"])).alias("label"),
            at(s["start_frame"]).alias("start_s"), at(s["end_frame"]).alias("end_s"),
            g["gop"].alias("gop"), g["confidence"].alias("confidence"), s["frames"].alias("frames"))))
    phones = segments.withColumn("phones", measured)
    sure = F.coalesce(mean(F.transform("phones", lambda p: p["confidence"])), F.lit(0.0))
    placed = phones.withColumn("_sure", sure).withColumn("_a", alignment_status(
        F.col("has_speech"), F.col("clipping"), F.col("too_quiet"), F.col("_sure")))
    aligned = placed.withColumns({
        "alignment": F.when(F.col("path").isNull(), "failed").otherwise(F.col("_a.status")),
        "reason": F.coalesce(F.when(usable, F.col("problem")), F.col("_a.reason"))})
    focus = F.get("phones", F.col("focus"))
    own = F.get("targets", F.col("focus"))
    args = (F.col("frames"), focus["frames"], own, F.col("confusions"))
    judged = aligned.withColumns({
        "target": token(own),
        "contrast": F.when(F.col("alignment") == "ok", F.struct(
            P.contrast_mean(*args).alias("mean"), P.contrast_spike(*args).alias("spike"),
            P.contrast_vote(*args).alias("vote"),
            P.heard(*args, blank, F.array(*[F.lit(k) for k in names])).alias("heard")))})
    fitted = match_calibration(judged, calib)
    variant = F.col("score_variant")
    value = F.when(variant == "spike", F.col("contrast.spike")).when(
        variant == "vote", F.col("contrast.vote")).when(variant == "gop", focus["gop"]).otherwise(
        F.col("contrast.mean.score"))
    scored = fitted.withColumns({
        "_d": decide(value, "platt_a", "platt_b", "threshold"),
        "calibrated": F.col("score_variant").isNotNull()})
    tones = nuclear_tone(tracks).select(
        F.col("clip").alias("take"), F.col("tone").alias("tone_detected"),
        F.round("confidence", 3).alias("tone_confidence"))
    rows = scored.join(tones, "take", "left").withColumns({
        "verdict": F.when(F.col("contrast").isNotNull(), F.col("_d.verdict")),
        "confidence": F.round("_d.confidence", 4),
        "detected": F.when(F.col("_d.is_detected"), token(F.col("contrast.mean.best"))),
        "heard": token(F.col("contrast.heard.token")),
        "hearing_score": F.col("contrast.heard.hearing_score"),
        "phone_index": F.col("focus"), "start_s": focus["start_s"], "end_s": focus["end_s"],
        "tone_expected": F.col("expected_tone")})
    return rows.select("take", *_result(token, include_ungated))


def _result(token, include_ungated: bool) -> list[Column]:
    kept = F.col("alignment") != "failed"
    none = F.array()
    phones = F.transform("phones", lambda p: F.struct(
        p["index"].alias("index"), p["label"].alias("label"), p["start_s"].alias("start_s"),
        p["end_s"].alias("end_s"), F.round(p["gop"], 4).alias("gop"),
        phone_score(p["gop"], p["index"] == F.col("focus"), "gop_a", "gop_b").alias("score"),
        F.round(p["confidence"], 4).alias("confidence")))
    word = F.struct(
        F.col("text").alias("text"), F.get("phones", F.lit(0))["start_s"].alias("start_s"),
        F.get("phones", F.size("phones") - 1)["end_s"].alias("end_s"),
        F.transform("phones", lambda p: p["index"]).alias("phone_indices"))
    closed = F.concat(F.array(F.get("targets", F.col("focus"))), F.col("confusions"))
    shares = F.map_from_arrays(
        F.transform(closed, token), F.transform("contrast.mean.posteriors", lambda p: F.round(p, 4)))
    contrast = F.struct(
        F.col("focus").alias("phone_index"), F.col("target"),
        F.transform("confusions", token).alias("confusion_set"), shares.alias("posteriors"),
        F.col("verdict"), F.col("detected"), F.col("confidence"), F.col("heard"),
        F.round("hearing_score", 4).alias("hearing_score"),
        F.round("contrast.spike", 4).alias("spike_score"), F.round("contrast.vote", 4).alias("vote_fraction"))
    prosody = F.when(F.col("tone_detected").isNotNull(), F.struct(
        F.col("tone_detected").alias("detected"), F.col("expected_tone").alias("expected"),
        F.when(F.col("expected_tone").isNotNull(), F.col("tone_detected") == F.col("expected_tone")).alias("match"),
        F.col("tone_confidence").alias("confidence")))
    alignment = F.struct(
        F.col("alignment").alias("status"), F.round("_sure", 4).alias("confidence"),
        F.when(~kept, F.col("reason")).alias("reason"),
        F.when(kept, F.array(word)).otherwise(none.cast(
            "array<struct<text:string,start_s:double,end_s:double,phone_indices:array<int>>>")).alias("words"),
        F.when(kept, phones).alias("phones"))
    return [
        F.lit("1.0").alias("schema_version"), alignment.alias("alignment"),
        F.array_compact(F.array(F.when(F.col("contrast").isNotNull(), contrast))).alias("contrasts"),
        prosody.alias("nuclear_tone"), feedback_items(include_ungated).alias("feedback")]


def token_records(results: DataFrame) -> DataFrame:
    """Rows of ``analyze`` as the fields that a token record takes from an analysis.

    The score and the best confusion come from the reported posteriors; without a contrast they and the
    verdict are null.
    """
    contrast = F.get("contrasts", F.lit(0))
    raw = raw_score(contrast["posteriors"], contrast["target"])
    judged = contrast.isNotNull() & (F.size(contrast["posteriors"]) > 0)
    focus = F.get("alignment.phones", contrast["phone_index"])
    fields = ["verdict", "confidence", "heard", "hearing_score", "spike_score", "vote_fraction"]
    problems = [K.NO_SPEECH, K.CLIPPING, K.NO_SIGNAL]
    return results.select(
        "take", F.col("alignment.status").alias("alignment"), F.col("alignment.reason").alias("reason"),
        F.coalesce(F.col("alignment.reason").isin(problems), F.lit(False)).alias("audio_problem"),
        F.when(judged, raw["score"]).alias("score"), F.when(judged, raw["best"]).alias("best_confusion"),
        *[F.when(judged, contrast[f]).alias(f) for f in fields], focus["gop"].alias("gop"),
        F.col("alignment.confidence").alias("alignment_confidence"))


def analyze_tokens(
    work: DataFrame, posteriors: DataFrame, tracks: DataFrame, calib: DataFrame, names: dict[int, str], blank: int = 0,
) -> DataFrame:
    """Token records of new takes: ``work`` without its ``logits``, which ``posteriors`` holds by ``take``.

    The tables may hold far more takes than ``work``; only theirs are packed and measured.
    """
    mine = tracks.join(work.select(F.col("take").alias("clip")).distinct(), "clip", "left_semi")
    takes = work.join(posteriors.select("take", "logits"), "take")
    return token_records(analyze(takes, mine, calib, names, blank, include_ungated=True))
