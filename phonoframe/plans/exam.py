"""The segment exam end to end: fit, sweep, test, audit, decide, calibrate, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe import schemas
from phonoframe.operators import calibrate as C
from phonoframe.operators import metrics as M
from phonoframe.operators import records as R
from phonoframe.operators import splits as S
from phonoframe.operators.storage import settle, store
from phonoframe.sources import corpora, sinks

VARIANTS = ["mean", "spike", "vote", "gop"]
NO_SCORES = "no-scores"
KEYS = ["utterance_id", "token_index"]
EXAMINED = [
    "split", "l1", "corpus", "label", "substituted_with", "audio_problem", "score", "spike_score", "vote_fraction", "gop",
    "heard", "hearing_score"]


def _by_variant(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add the columns of a table with at most one row for each of ``VARIANTS``."""
    return rows.join(F.broadcast(table), "variant", "left")


def _one_row(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add the columns of a one-row table."""
    return rows.crossJoin(F.broadcast(table))


def require_splits(records: DataFrame) -> None:
    """An exam needs calibration and test rows; three counts decide."""
    sizes = M.split_sizes(records).first()
    if not (sizes.cal and sizes.test):
        raise ValueError(f"the cal or test split is empty: {sizes.cal} and {sizes.test} tokens")


def variant_bakeoff(records: DataFrame) -> DataFrame:
    """Fit, sweep and test every scoring variant; one row per variant.

    All variants go through each step together: one grouped fit, one grouped sweep, one
    grouped test. Fits use calibration rows that have a mean score, metrics use all. A variant
    without scores there has the status ``no-scores`` and no figures; one whose fit does not
    converge has no operating point.
    """
    rows = M.variant_rows(records.filter(F.col("split").isin("cal", "test")))
    cal, test = rows.filter("split = 'cal'"), rows.filter("split = 'test'")
    scored = F.col("score").isNotNull() & F.col("value").isNotNull()
    fits = settle(C.fit_platt(cal.filter(scored), "value", M.is_positive(), ["variant"]).select(
        "variant", "a", "b", "converged"))
    usable = fits.filter("converged").select("variant", "a", "b")
    picked = settle(M.pick_threshold(
        cal.join(F.broadcast(usable), "variant"), "a", "b", "value", ["variant"],
    ).select("variant", "threshold", F.col("status").alias("cal_status")))
    points = usable.join(F.broadcast(picked), "variant")
    placed = test.join(F.broadcast(points), "variant")
    tested = M.score_metrics(placed, "a", "b", "threshold", "value", ["variant"])
    # the area under the curve only needs the order of calibrated scores
    ranked = placed.withColumn("_p", F.when(
        F.col("value").isNotNull(), F.lit(1.0) / (1.0 + F.exp(-(F.col("a") * F.col("value") + F.col("b"))))))
    areas = M.auc(ranked, "_p", M.is_positive(), ["variant"]).select("variant", "auc")
    names = records.sparkSession.createDataFrame([(v,) for v in VARIANTS], "variant string")
    whole = names
    for part in (fits, picked, tested, areas):
        whole = _by_variant(whole, part)
    status = F.when(F.col("converged").isNull(), NO_SCORES).when(~F.col("converged"), "no-fit").otherwise(
        M.final_status("cal_status"))
    return whole.withColumn("status", status)


def hearing_exam(records: DataFrame, target: str) -> DataFrame:
    """Mirror exam in one row: fit, operating point, held-out metrics, status.

    The fit uses rows with a hearing score and a known realisation on both sides. Without any, or if
    it does not converge, the row has the status ``no-scores`` and no figures.
    """
    realized = M.realized_of(target)
    cal, test = (records.filter(F.col("split") == s) for s in ("cal", "test"))
    fit = settle(C.fit_platt(
        cal.filter(F.col("heard").isNotNull() & realized.isNotNull()).withColumn("_pool", F.lit("all")),
        "hearing_score", F.col("heard") == realized, ["_pool"],
    ).filter("converged").select(F.col("a").alias("hearing_a"), F.col("b").alias("hearing_b")))
    point = settle(M.pick_hearing_threshold(_one_row(cal, fit), target, "hearing_a", "hearing_b").select(
        F.col("threshold").alias("hearing_threshold"), F.col("status").alias("_cal")))
    held = M.hearing_metrics(
        _one_row(_one_row(test, fit), point), target, "hearing_a", "hearing_b", "hearing_threshold")
    shown = _one_row(_one_row(held, fit), point).withColumn("hearing_status", M.hearing_status("_cal")).drop("_cal")
    row = records.sparkSession.createDataFrame([(0,)], "_row int")
    return row.join(shown, F.lit(True), "left").drop("_row").withColumn(
        "hearing_status", F.coalesce("hearing_status", F.lit(NO_SCORES)))


def run_exam(
    records: DataFrame, target: str, confusions: list[str], model_id: str, generated_by: str
) -> dict[str, DataFrame]:
    """Exam of token records that carry ``split``; an empty cal or test split is an error.

    Returns frames: variants, best, hearing, metrics (of every variant on cal and test), audit_l1 and
    audit_corpus (of every variant), auc_corpus, hearing_audit, hearing_confusion, alignment, latency, summary and calibration.
    The cal and test rows are written once, with the columns that the exam looks at; the fits and sweeps read that table.
    """
    whole, records = records, store(records.filter(F.col("split").isin("cal", "test")).select(*EXAMINED))
    require_splits(records)
    variants = settle(variant_bakeoff(records))
    best = settle(M.pick_variant(variants))
    hearing = settle(hearing_exam(records, target))
    gop = settle(C.fit_platt(
        records.filter((F.col("split") == "cal") & F.col("score").isNotNull()).withColumn("_pool", F.lit("all")),
        "gop", ~M.is_positive(), ["_pool"]).select(F.col("a").alias("gop_a"), F.col("b").alias("gop_b")))
    test = records.filter(F.col("split") == "test")
    points = variants.select("variant", "a", "b", "threshold")
    long = M.variant_rows(test).join(F.broadcast(points), "variant")
    frames = {
        f"audit_{g}": M.score_metrics(long, "a", "b", "threshold", "value", ["variant", g]).withColumn("ok", M.group_ok())
        for g in ("l1", "corpus")}
    sides = M.variant_rows(records).join(F.broadcast(points), "variant")
    frames["metrics"] = M.score_metrics(sides, "a", "b", "threshold", "value", ["variant", "split"])
    chosen = long.join(F.broadcast(best.select("variant")), "variant", "left_semi")
    frames["auc_corpus"] = M.auc(chosen.withColumn("_p", _probability("value", "a", "b")), "_p", M.is_positive(), ["corpus"])
    mirrored = _one_row(test, hearing.select("hearing_a", "hearing_b", "hearing_threshold"))
    frames["hearing_audit"] = M.hearing_audit(
        mirrored, target, "hearing_a", "hearing_b", "hearing_threshold", ["l1"])
    frames["hearing_confusion"] = M.confusion(
        mirrored, target, "hearing_a", "hearing_b", "hearing_threshold", [target, *confusions])
    frames["alignment"] = M.status_stats(whole)
    frames["latency"] = M.latency(whole, ["utterance_id", "token_index"])
    sizes = M.split_sizes(whole)
    shown = best.select(
        F.lit(model_id).alias("model_id"), F.lit(target).alias("target"),
        F.array(*[F.lit(c) for c in confusions]).alias("confusions"),
        F.lit(generated_by).alias("generated_by"), F.col("variant").alias("score_variant"),
        F.col("a").alias("platt_a"), F.col("b").alias("platt_b"), "threshold",
        F.col("status").alias("judge_status"), "precision", "recall", "f1", "auc",
    )
    summary = _one_row(shown, hearing.select(
        "hearing_a", "hearing_b", "hearing_threshold", "hearing_status", "accuracy", "coverage"))
    summary = _one_row(summary.join(F.broadcast(gop), F.lit(True), "left"), sizes)
    return {
        "variants": variants, "best": best, "hearing": hearing, **frames, "summary": summary,
        "calibration": C.build_calibration(summary)}


def _probability(value: str, a: str, b: str) -> Column:
    return F.when(F.col(value).isNotNull(), 1.0 / (1.0 + F.exp(-(F.col(a) * F.col(value) + F.col(b)))))


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of earlier runs; none where nothing was written yet."""
    try:
        return corpora.read_records(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.TOKEN_RECORD)


def evaluate(
    utts: DataFrame, tokens: DataFrame, roster: DataFrame, analyze: Callable[[DataFrame], DataFrame], path: str,
    target: str, confusions: list[str], model_id: str, generated_by: str, seed: int = 42,
    limit: int | None = None, include_train: bool = False,
) -> dict[str, DataFrame]:
    """From utterances to the exam: collect, split, leave out what is recorded, analyse, record, examine, sample.

    ``analyze`` takes collected tokens and returns token records; it only sees tokens without a record in ``path``,
    where its records are appended. Train tokens are the scorer's own material and stay out unless asked for;
    ``limit`` keeps so many utterances. Returns the frames of ``run_exam`` over all records in ``path`` and with
    them ``records``, ``flagged_sample`` and ``hearing_sample``.
    """
    spark = utts.sparkSession
    work = R.collect_tokens(utts, tokens, target, confusions, roster, seed)
    if not include_train:
        work = work.filter("split <> 'train'")
    if limit is not None:
        work = S.limit_utterances(work, limit)
    new = R.pending(work, stored_records(spark, path), KEYS)
    sinks.append_records(analyze(new).select(*[f.name for f in schemas.TOKEN_RECORD]), path)
    records = corpora.read_records(spark, path)
    frames = run_exam(records, target, confusions, model_id, generated_by)
    return {"records": records, **frames, **review_samples(records, frames, target, seed)}


def review_samples(records: DataFrame, frames: dict[str, DataFrame], target: str, seed: int = 42) -> dict[str, DataFrame]:
    """What people should listen to: flagged tokens and confident reports of the held-out records.

    The operating points are two rows of the exam. A scorer without one has no sample.
    """
    test = records.filter(F.col("split") == "test")
    best, hearing = frames["best"].first(), frames["hearing"].first()
    out = {}
    if best is not None and best.threshold is not None:
        out["flagged_sample"] = S.flagged_sample(test, best.a, best.b, best.threshold, seed, C.VARIANTS[best.variant])
    if hearing is not None and hearing.hearing_threshold is not None:
        out["hearing_sample"] = S.hearing_sample(
            test, target, hearing.hearing_a, hearing.hearing_b, hearing.hearing_threshold, seed)
    return out
