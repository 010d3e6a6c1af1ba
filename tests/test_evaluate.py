"""The exam from utterances to the report on a small corpus."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from phonoframe import schemas
from phonoframe.operators import labels as L
from phonoframe.operators import records as R
from phonoframe.operators import splits as SP
from phonoframe.plans import exam, report

UTTS = "utterance_id string, l1 string, corpus string, speaker string, native_split string"
TOKENS = "utterance_id string, token_index int, phone string"


def corpus(spark, n=240):
    rng = random.Random(6)
    utts = [(f"u{k}", f"l{k % 2}", "open", f"s{k % 8}", "") for k in range(n)] + [("none", "l0", "open", "s0", "")]
    tokens = [(f"u{k}", i, rng.choice(["ð", "s", "z"]) if i else "ð") for k in range(n) for i in range(3)] + [("none", 0, "s")]
    utts, tokens = spark.createDataFrame(utts, UTTS), spark.createDataFrame(tokens, TOKENS)
    return utts, tokens, utts.select("speaker", "l1").distinct()


def scored(seen):
    """Records of collected tokens with noisy scores that tell substitutions apart."""
    def analyze(work):
        rows = work.collect()
        seen.extend((r.utterance_id, r.token_index) for r in rows)
        out = []
        for r in rows:
            rng = random.Random(f"{r.utterance_id}:{r.token_index}")
            wrong = rng.random() < 0.4
            blank = {f.name: None for f in schemas.TOKEN_RECORD}
            score = (1.5 if wrong else -1.5) + rng.gauss(0, 1)
            out.append({**blank, "utterance_id": r.utterance_id, "token_index": r.token_index, "corpus": r.corpus, "l1": r.l1,
                        "split": r.split, "label": "substituted" if wrong else "correct", "substituted_with": "z" if wrong else None,
                        "alignment": "ok", "audio_problem": False, "score": score, "spike_score": score, "vote_fraction": rng.random(),
                        "gop": -score, "heard": "z" if score > 0 else "ð", "hearing_score": abs(score), "best_confusion": "z",
                        "alignment_confidence": 0.9, "wall_ms": 10.0, "start_s": 0.0, "end_s": 1.0})
        return work.sparkSession.createDataFrame(out, schemas.TOKEN_RECORD)

    return analyze


def test_collected_tokens_carry_split_and_focus(spark):
    utts, tokens, roster = corpus(spark, 12)
    got = R.collect_tokens(utts, tokens, "ð", ["z", "d"], roster).collect()
    wanted = {(r.utterance_id, r.token_index) for r in tokens.filter("phone = 'ð'").collect()}
    assert {(r.utterance_id, r.token_index) for r in got} == wanted
    splits = {r.utterance_id: r.split for r in SP.assign_split(utts, roster).collect()}
    for r in got:
        assert r.split == splits[r.utterance_id]
        assert [(p["index"], p["focus"], p["confusions"]) for p in r.phones] == [
            (i, i == r.token_index, ["z", "d"] if i == r.token_index else []) for i in range(3)]


def test_exam_resumes_and_reports(spark, tmp_path):
    utts, tokens, roster = corpus(spark)
    path, seen = str(tmp_path / "records"), []
    args = (roster, scored(seen), path, "ð", ["z"], "m1", "reports/x.json")
    with pytest.raises(ValueError):  # one utterance: a split is empty, its records stay
        exam.evaluate(utts, tokens, *args, limit=1)
    first = list(seen)
    assert len(first) == 1
    frames = exam.evaluate(utts, tokens, *args)
    again = exam.evaluate(utts, tokens, *args)
    splits = {r.utterance_id: r.split for r in SP.assign_split(utts, roster).collect()}
    wanted = {(r.utterance_id, r.token_index) for r in tokens.filter("phone = 'ð'").collect() if splits[r.utterance_id] != "train"}
    assert len(seen) == len(set(seen)) and set(seen) == wanted
    assert frames["summary"].collect() == again["summary"].collect()
    assert frames["records"].count() == len(wanted)
    sample = frames["flagged_sample"].collect()
    assert 0 < len(sample) <= 30 and {r.utterance_id for r in sample} <= {u for u, _ in wanted}
    lines = report.report_lines(frames).orderBy("order", "rank").collect()
    titles = [r.line for r in lines if r.line.startswith("## ")]
    assert titles == ["## " + t for t in (
        "Exam", "Mirror", "Realised and heard", "Mirror by first language", "Reports to listen to", "Judge variants",
        "Judge operating point", "Judge on cal", "Judge held-out", "Judge by first language", "Judge by corpus", "Alignment",
        "Latency", "Flags to listen to")]
    audit = {r.l1: r for r in frames["audit_l1"].join(frames["best"].select("variant"), "variant").collect()}
    table = [r.line for r in lines if r.section == "Judge by first language"][3:]
    assert table == [f"| {k} | {a.tokens} | {a.positives} | {a.precision} | {a.recall} | {a.f1} | {str(a.ok).lower()} |" for k, a in sorted(audit.items())]


def test_caps_take_the_first_hashes_of_every_class(spark):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(3000)}", rng.choice(["a", "b", None])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "f string, label string")
    ranked = df.withColumn("h", F.md5(F.concat_ws(":", F.lit("42:cap"), "f"))).collect()
    for n in (0, 1, 700, 5000):
        got = SP.cap_per_class(df, n, "label", F.lit(False), ["f"]).collect()
        for label in ("a", "b", None):
            wanted = sorted((r.h, r.f) for r in ranked if r.label == label)[:n]
            assert sorted(f for _, f in wanted) == sorted(r.f for r in got if r.label == label)
    assert SP.cap_rows(df, 10, ["f"]).count() == 10


def test_budget_equals_a_running_sum(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.randint(1, 40))) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, duration double")
    for budget, cap in ((1e9, None), (3000.0, None), (3000.0, 77), (0.0, None), (1e9, 1)):
        got = SP.budget_select(df, "id", "duration", budget, cap, F.expr("id div 16")).collect()
        wanted, total = [], 0.0
        for k, d in rows:
            if 1 <= d <= 30:
                if total < budget and (cap is None or len(wanted) < cap):
                    wanted.append(k)
                total += d
        assert sorted(r.id for r in got) == wanted


def test_quarantine_is_counted_in_the_pass_that_writes(spark, tmp_path):
    seen = Observation("held")
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None)], "source string, raw string")
    good, held = L.quarantine(df, F.coalesce("raw", F.lit("")) == "", "source", "raw", "empty", seen)
    good.write.parquet(str(tmp_path / "good"))
    assert seen.get == {"rows": 3, "held": 2} and held.count() == 2
