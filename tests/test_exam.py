"""Hand examples and invariants of the exam statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions import scalar as S
from phonoframe.operators import calibrate as C
from phonoframe.operators import metrics as M
from phonoframe.operators import ranks as R
from phonoframe.operators import splits as SP
from phonoframe.plans import exam


def records(spark, rows):
    return spark.createDataFrame(
        [(s, lab, False) for s, lab in rows], "score double, label string, audio_problem boolean")


def test_refused_positive_counts_as_missed(spark):
    df = records(spark, [(3.0, "substituted"), (None, "substituted"), (-3.0, "correct")])
    row = M.score_metrics(df, 1.0, 0.0, 0.5).first()
    assert (row.tokens, row.positives, row.verdicts, row.refused) == (3, 2, 2, 1)
    assert (row.tp, row.fp, row.fn) == (1, 0, 1)
    assert row.precision == 1.0 and row.recall == 0.5 and row.f1 == 0.6667


def test_sweep_skips_the_false_alarm(spark):
    rows = [(2.4, "correct"), (3.0, "substituted"), (4.0, "substituted")]
    row = M.pick_threshold(records(spark, rows), 1.0, 0.0).first()
    assert row.status == "ok" and row.precision == 1.0 and row.recall == 1.0
    assert 1 / (1 + math.exp(-2.4)) < row.threshold <= 1 / (1 + math.exp(-3.0))


def test_sweep_without_passing_threshold(spark):
    row = M.pick_threshold(records(spark, [(3.0, "correct"), (3.0, "substituted")]), 1.0, 0.0).first()
    assert row.status == K.BAR_NOT_MET and row.precision == 0.5 and row.threshold == 0.95


def test_null_scores_pass_no_threshold(spark):
    df = spark.createDataFrame([(None,), (0.5,), (0.995,), (0.4999,), (0.505,)], "p double")
    got = [r[0] for r in df.select(M.thresholds_passed(F.col("p"))).collect()]
    assert got == [None, 1, 100, 0, 2]


def test_every_listed_threshold_passes_itself(spark):
    df = spark.createDataFrame([(t,) for t in K.THRESHOLDS], "p double")
    assert [r[0] for r in df.select(M.thresholds_passed(F.col("p"))).collect()] == list(range(1, 101))


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return round(wins / (len(pos) * len(neg)), 4)


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    pairs = [(rng.choice([0.0, 0.5, 1.0, rng.gauss(0, 3)]), rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(pairs, "s double, y boolean")
    assert M.auc(df, "s", F.col("y")).first().auc == brute_auc(pairs)
    assert M.auc(df.filter("y"), "s", F.col("y")).first().auc is None


def test_platt_fit_is_stationary(spark):
    rng = random.Random(5)
    rows = [(x, rng.random() < 1 / (1 + math.exp(-(1.3 * x - 0.4)))) for x in (rng.gauss(0, 2) for _ in range(400))]
    fit = C.fit_platt(spark.createDataFrame(rows, "x double, y boolean"), "x", F.col("y")).first()
    p = [1 / (1 + math.exp(-(fit.a * x + fit.b))) for x, _ in rows]
    assert fit.converged
    assert abs(sum(y - q for (_, y), q in zip(rows, p))) < 1e-6
    assert abs(sum(x * (y - q) for (x, y), q in zip(rows, p))) < 1e-6


def test_platt_single_class_groups(spark):
    rows = [("t", 1.0, True), ("t", 2.0, True), ("f", 1.0, False), ("m", 0.0, True), ("m", 0.0, False)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean")
    fit = {r.g: (r.a, r.b) for r in C.fit_platt(df, "x", F.col("y"), ["g"]).collect()}
    assert fit == {"t": (0.0, 0.0), "f": (0.0, -1.0), "m": (0.0, 0.0)}
    with pytest.raises(ValueError):
        C.fit_platt(df.filter("x > 9"), "x", F.col("y"))


def test_verdict_band(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (0.1,), (None,)], "s double")
    got = df.select(C.decide("s", F.lit(1.0), F.lit(0.0), F.lit(0.8)).alias("d")).select("d.*").collect()
    assert [r.verdict for r in got] == ["substituted", "on_target", "uncertain", "uncertain"]
    assert got[3].confidence == 0.0


def test_raw_score_example(spark):
    df = spark.range(1).select(F.create_map(
        F.lit("ð"), F.lit(0.2), F.lit("z"), F.lit(0.7), F.lit("d"), F.lit(0.1)).alias("m"))
    row = df.select(S.raw_score("m", "ð").alias("s")).select("s.*").first()
    assert row.best == "z" and abs(row.score - math.log(3.5)) < 1e-9


def test_running_sums_match_a_plain_window_on_a_hot_key(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else None, rng.randrange(5000), rng.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v int").withColumn("id", F.monotonically_increasing_id())
    got = R.running(df, ["k"], ["t", "id"], {"s": F.col("v")}, F.expr("t div 64")).select("k", "t", "v", "s").collect()
    for key in ("hot", None):
        mine = sorted((r.t, r.s, r.v) for r in got if r.k == key)
        assert mine[-1][1] == sum(v for k, _, v in rows if k == key)
        assert len(mine) == sum(k == key for k, _, _ in rows)


def test_positions_interpolate(spark):
    import numpy as np
    rng = random.Random(2)
    values = [rng.choice([-3.0, rng.gauss(0, 50), 7.0]) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = R.positions(df, [], "v", {"m": R.median_rank(), "p": R.percentile_rank(95)}).first()
    assert abs(row.m - np.median(values)) < 1e-9 and abs(row.p - np.percentile(values, 95)) < 1e-9


def tokens(spark):
    rows = [(f"u{k}", f"s{k % 12}" if k % 20 else None, f"l{k % 3}", "native" if k % 4 == 0 else "open",
             "test" if k % 8 == 0 else "train") for k in range(600)]
    return spark.createDataFrame(rows, "utterance_id string, speaker string, l1 string, corpus string, native_split string")


def test_split_is_stable_and_speaker_disjoint(spark):
    roster = tokens(spark).select("speaker", "l1").distinct()
    df = SP.assign_split(tokens(spark), roster)
    assert df.count() == 600
    assert sorted(df.collect()) == sorted(SP.assign_split(tokens(spark).repartition(3), roster).collect())
    # a part of the rows keeps the splits of the whole, and strangers fall back to their utterance
    part = tokens(spark).filter("utterance_id LIKE '%7'")
    assert sorted(SP.assign_split(part, roster).collect()) == sorted(df.filter("utterance_id LIKE '%7'").collect())
    stranger = part.filter("corpus = 'open'").withColumn("speaker", F.lit("new"))
    assert "cal" not in {r.split for r in SP.assign_split(stranger, roster).collect()}
    opened = df.filter("corpus = 'open' AND speaker IS NOT NULL")
    assert SP.leakage(opened, "speaker").isEmpty()
    roles = opened.select("l1", "split").distinct().groupBy("l1").count().collect()
    assert all(r["count"] >= 2 for r in roles)
    assert df.filter("corpus = 'native' AND native_split = 'test' AND split <> 'test'").isEmpty()


def test_balanced_batches_share_slots(spark):
    rows = [(f"r{k}", "ð" if k % 10 else "z") for k in range(100)]
    df = spark.createDataFrame(rows, "id string, label string")
    got = SP.balanced_batches(df, "label", ["id"], 8).collect()
    assert len(got) == 13 * 8
    by_batch = {}
    for r in got:
        by_batch.setdefault(r.batch, []).append(r.label)
    assert all(sorted(v) == ["z"] * 4 + ["ð"] * 4 for v in by_batch.values())
    assert len({r.id for r in got if r.label == "z"}) == 10


def test_budget_keeps_the_clip_that_crosses(spark):
    df = spark.createDataFrame([(k, 10.0) for k in range(10)] + [(10, 99.0)], "id int, duration double")
    got = SP.budget_select(df, "id", "duration", 25.0, None, F.lit(0))
    assert sorted(r.id for r in got.collect()) == [0, 1, 2]


def test_cap_never_drops_exempt_rows(spark):
    df = spark.createDataFrame([(f"f{k}", "ð" if k % 2 else "z") for k in range(100)], "f string, label string")
    got = SP.cap_per_class(df, 7, "label", F.col("label") == "ð", ["f"]).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"ð": 50, "z": 7}


def test_separable_fits_are_refused(spark):
    rows = [("s", float(x), x > 3) for x in range(8)] + [("o", float(x % 4), x % 3 == 0) for x in range(40)]
    fit = {r.g: r for r in C.fit_platt(spark.createDataFrame(rows, "g string, x double, y boolean"), "x", F.col("y"), ["g"]).collect()}
    assert not fit["s"].converged and fit["s"].a is None and fit["o"].converged and fit["o"].a is not None


def exam_records(spark, heard=True, spike=True):
    rng = random.Random(8)
    rows = []
    for k in range(900):
        bad = rng.random() < 0.4
        score = rng.gauss(1.2 if bad else -1.2, 1.0)
        rows.append((f"u{k // 3}", k % 3, ["train", "cal", "test"][k % 3], "substituted" if bad else "correct", "z" if bad else None,
                     score, score + rng.gauss(0, 1) if spike else None, rng.random(), -score + rng.gauss(0, 1), f"l{k % 4}",
                     "open", ("z" if bad else "ð") if heard and rng.random() < 0.9 else None, rng.gauss(1, 1) if heard else None,
                     "ok", 0.9, False, 100.0 + k))
    return spark.createDataFrame(rows, "utterance_id string, token_index int, split string, label string, substituted_with string, "
        "score double, spike_score double, vote_fraction double, gop double, l1 string, corpus string, heard string, "
        "hearing_score double, alignment string, alignment_confidence double, audio_problem boolean, wall_ms double")


def test_exam_lists_variants_without_scores_and_keeps_its_summary(spark):
    records = exam_records(spark, heard=False, spike=False)
    frames = exam.run_exam(records, "ð", ["z", "d", "v"], "m1", "reports/run.json")
    status = {r.variant: r.status for r in frames["variants"].collect()}
    assert set(status) == {"mean", "spike", "vote", "gop"} and status["spike"] == "no-scores" and status["mean"] != "no-scores"
    summary = frames["summary"].collect()
    assert len(summary) == 1 and summary[0].hearing_status == "no-scores" and summary[0].score_variant == "mean"
    assert frames["calibration"].collect() == [] and frames["hearing_confusion"].collect() == []
    with pytest.raises(ValueError):
        exam.run_exam(records.filter("split <> 'cal'"), "ð", ["z"], "m1", "r")


def test_exam_reports_every_part_without_cartesian_products(spark):
    frames = exam.run_exam(exam_records(spark), "ð", ["z", "d", "v"], "m1", "reports/run.json")
    assert frames["hearing"].count() == 1 and {r.variant for r in frames["audit_l1"].collect()} == {"mean", "spike", "vote", "gop"}
    assert frames["auc_corpus"].count() == 1 and frames["hearing_audit"].count() == 4 and frames["latency"].count() == 1
    for name in ("summary", "audit_l1", "hearing_audit"):
        plan = frames[name]._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_confident_reports_outside_the_list_have_a_column(spark):
    rows = [("substituted", "z", "x", 9.0), ("correct", None, "ð", 9.0), ("correct", None, "x", 9.0), ("correct", None, "y", -9.0)]
    df = spark.createDataFrame(rows, "label string, substituted_with string, heard string, hearing_score double")
    got = M.confusion(df, "ð", 1.0, 0.0, 0.6, ["ð", "z"])
    assert got.columns == ["realized", "ð", "z", "x", "is_target"]
    assert [tuple(r) for r in got.collect()] == [("ð", 1, 0, 1, True), ("z", 0, 0, 1, False)]
