"""Queries over whole plans: feedback, calibration files, exams, streams, exports."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.bindings import views as V
from phonoframe.bindings.contours import TONE_CTE, semis
from phonoframe.bindings.labels import speaker_roster, utterance_rows
from phonoframe.bindings.records import (
    EXPORT_CTE, GRID_CTE, MIRROR_RATES, OK, POS, REAL, VERDICT, exported, newton_cte, rated, sig, with_verdicts,
)
from phonoframe import schemas
from phonoframe.operators import calibrate as C
from phonoframe.operators import metrics as M
from phonoframe.operators.storage import scratch, settle
from phonoframe.plans import analysis, exam, feedback, report
from phonoframe.sources import corpora, sinks
from phonoframe.streaming import records as L

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# -- feedback --------------------------------------------------------------------------


def feedback_rows(spark, sf):
    calib = V.table(spark, sf, "region").select(
        F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model_id"), F.lit("ð").alias("target"),
        F.when(F.col("r_regionkey") != 2, 1.0 + F.col("r_regionkey") / 4.0).alias("a"),
        F.when(F.col("r_regionkey") != 2, F.lit(0.1)).alias("b"),
        F.when(F.col("r_regionkey") != 2, 0.6 + F.col("r_regionkey") / 20.0).alias("threshold"),
        F.when(F.col("r_regionkey") != 1, F.lit(V.HA)).alias("hearing_a"),
        F.when(F.col("r_regionkey") != 1, F.lit(V.HB)).alias("hearing_b"),
        F.when(F.col("r_regionkey") != 1, F.lit(V.HTHR)).alias("hearing_threshold"), F.lit(True).alias("calibrated"))
    tokens = V.li(spark, sf).withColumns({
        "model_id": F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")), "target": F.col("phone")})
    rows = C.match_calibration(tokens, calib).withColumn("_d", C.decide("score", "a", "b", "threshold"))
    tones = F.array(*[F.lit(t) for t in K.TONES])
    return rows.withColumns({
        "verdict": F.col("_d.verdict"), "confidence": F.round("_d.confidence", 4),
        "detected": F.when(F.col("_d.is_detected"), F.col("best_confusion")),
        "heard": F.when(F.col("l_partkey") % 23 == 0, "other").otherwise(F.col("heard")),
        "calibrated": F.coalesce("calibrated", F.lit(False)), "phone_index": F.col("l_linenumber"),
        "tone_detected": F.when(F.col("l_suppkey") % 5 != 0, F.element_at(tones, (1 + F.col("l_suppkey") % 4).cast("int"))),
        "tone_expected": F.when(F.col("l_partkey") % 3 == 0, F.element_at(tones, (1 + F.col("l_partkey") % 4).cast("int"))),
        "tone_confidence": (F.col("l_partkey") % 100) / 100.0})


def tone_pick(index: str) -> str:
    return f"(['fall', 'rise', 'fall_rise', 'level'][CAST(1 + {index} % 4 AS INT)])"


def tone_text(c: str) -> str:
    return f"CASE {c} WHEN 'fall' THEN 'a falling tone' WHEN 'rise' THEN 'a rising tone' WHEN 'fall_rise' THEN 'a falling-then-rising tone' ELSE 'a flat tone' END"


FEED_CTE = f"""{V.LI_CTE}, cal AS (SELECT 'm' || r_regionkey AS model_id, 'ð' AS target, CASE WHEN r_regionkey <> 2 THEN 1.0e0 + r_regionkey / 4.0e0 END AS a,
    CASE WHEN r_regionkey <> 2 THEN 0.1e0 END AS b, CASE WHEN r_regionkey <> 2 THEN 0.6e0 + r_regionkey / 20.0e0 END AS threshold, CASE WHEN r_regionkey <> 1 THEN 0.8e0 END AS ht, true AS calibrated FROM region),
  fr0 AS (SELECT li0.* EXCLUDE (heard), CASE WHEN l_partkey % 23 = 0 THEN 'other' ELSE heard END AS heard, phone AS target, a, b, threshold, ht, coalesce(calibrated, false) AS calibrated,
    CASE WHEN l_suppkey % 5 <> 0 THEN {tone_pick('l_suppkey')} END AS td, CASE WHEN l_partkey % 3 = 0 THEN {tone_pick('l_partkey')} END AS te, round((l_partkey % 100) / 100.0e0, 4) AS tc
    FROM li0 LEFT JOIN cal ON cal.model_id = 'm' || (l_partkey % 7) AND cal.target = phone),
  fr AS (SELECT *, {VERDICT} AS verdict, {sig('1.2e0', '0.1e0', 'hearing_score')} AS hp FROM fr0),
  items AS (
   SELECT audio_path, 0 AS o, 'retry' AS id, 'retry' AS kind, 'warning' AS severity, 1.0e0 AS confidence, 'feedback.retry' AS message_key,
     CASE reason WHEN '{K.NO_SPEECH}' THEN '{K.RETRY[K.NO_SPEECH].replace("'", "''")}' WHEN 'clipping' THEN '{K.RETRY["clipping"]}' ELSE '{K.RETRY_DEFAULT.replace("'", "''")}' END AS message,
     CAST(NULL AS INT) AS phone_index, CAST(NULL AS INT) AS contrast_index FROM fr WHERE alignment <> 'ok'
   UNION ALL SELECT audio_path, 1, 'substitution-0', 'segmental_substitution', 'warning', CASE WHEN score IS NULL OR a IS NULL THEN 0.0e0 ELSE round({sig('a', 'b', 'score')}, 4) END, 'feedback.segmental_substitution',
     CASE verdict WHEN 'uncertain' THEN '/' || target || '/ here was hard to pin down — try it once more, a little slower.' ELSE 'That /' || target || '/ sounded more like /' || best_confusion || '/.' END,
     l_linenumber, 0 FROM fr WHERE alignment = 'ok' AND calibrated AND verdict IN ('substituted', 'uncertain')
   UNION ALL SELECT audio_path, 2, 'hearing-0', 'phone_hearing', CASE WHEN hp >= ht AND heard = target THEN 'praise' ELSE 'warning' END, round(hp, 4),
     CASE WHEN hp < ht THEN 'feedback.phone_hearing_unsure' WHEN heard = target THEN 'feedback.phone_hearing_on_target' ELSE 'feedback.phone_hearing_other' END,
     CASE WHEN hp < ht THEN 'I couldn''t tell what that /' || target || '/ sounded like — try once more, a little slower.' WHEN heard = target THEN 'I heard /' || heard || '/ — right on target.'
       ELSE 'I heard ' || CASE heard WHEN 'other' THEN 'something else' ELSE '/' || heard || '/' END || ' where you were going for /' || target || '/.' END,
     l_linenumber, 0 FROM fr WHERE alignment = 'ok' AND calibrated AND ht IS NOT NULL AND hp IS NOT NULL AND heard IS NOT NULL
   UNION ALL SELECT audio_path, 3, 'tone', 'intonation_tone', CASE WHEN tc >= 0.3e0 AND td = te THEN 'praise' ELSE 'warning' END, tc,
     CASE WHEN tc < 0.3e0 THEN 'feedback.tone_uncertain' WHEN td = te THEN 'feedback.tone_match' ELSE 'feedback.tone_mismatch' END,
     CASE WHEN tc < 0.3e0 THEN 'I couldn''t hear the melody clearly enough - try that one again.' WHEN td = te THEN 'That ended with ' || {tone_text('te')} || ' - right on target.'
       ELSE 'The target is ' || {tone_text('te')} || ', but that ended with ' || {tone_text('td')} || '.' END, NULL, NULL FROM fr WHERE td IS NOT NULL AND te IS NOT NULL)"""


@query(f"WITH {FEED_CTE} SELECT audio_path, row_number() OVER (PARTITION BY audio_path ORDER BY o) - 1 AS position, id, severity, confidence, message_key, message, phone_index, contrast_index FROM items")
def k6_compose_feedback(spark, sf):
    rows = feedback.compose_feedback(feedback_rows(spark, sf), ["audio_path"], include_ungated=True)
    return rows.drop("kind", "start_s", "end_s")


@query(f"WITH {FEED_CTE} SELECT audio_path, phone_index, CASE WHEN message_key = 'feedback.phone_hearing_other' AND message NOT LIKE 'I heard something%' THEN substr(message, 10, strpos(substr(message, 10), '/') - 1) END AS heard, "
       "message_key = 'feedback.phone_hearing_on_target' AS on_target, message_key = 'feedback.phone_hearing_unsure' AS unsure FROM items WHERE kind = 'phone_hearing'")
def k9_mirror_state(spark, sf):
    rows = feedback.compose_feedback(feedback_rows(spark, sf), ["audio_path"], include_ungated=True)
    return feedback.mirror_state(rows, ["audio_path"])


# -- calibration files --------------------------------------------------------------------


def exam_rows(spark, sf):
    n = F.col("n_nationkey")
    return V.table(spark, sf, "nation").select(
        F.col("n_name").alias("model_id"), F.lit("ð").alias("target"), F.array(F.lit("z"), F.lit("d")).alias("confusions"),
        F.lit("mean").alias("score_variant"), F.concat(F.lit("reports/"), "n_name").alias("generated_by"),
        F.when(n % 3 == 0, "ok").otherwise("pooled-bar-not-met").alias("judge_status"),
        (n / 10.0).alias("platt_a"), F.lit(0.5).alias("platt_b"), (0.5 + n / 100.0).alias("threshold"),
        F.when(n % 2 == 0, n / 5.0).alias("gop_a"), F.when(n % 2 == 0, F.lit(0.0)).alias("gop_b"),
        F.when(n % 4 != 1, "ok").otherwise("mirror-bar-not-met").alias("hearing_status"),
        (n / 7.0).alias("hearing_a"), F.lit(0.1).alias("hearing_b"), (0.6 + n / 200.0).alias("hearing_threshold"), (n * 20).alias("cal"))


@query("""SELECT n_name AS model_id, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 10.0e0 END AS platt_a, CASE WHEN n_nationkey % 3 = 0 THEN 0.5e0 + n_nationkey / 100.0e0 END AS threshold,
  CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 5.0e0 END AS gop_a, round(n_nationkey / 7.0e0, 6) AS hearing_a, 0.6e0 + n_nationkey / 200.0e0 AS hearing_threshold FROM nation WHERE n_nationkey % 4 <> 1 AND n_nationkey * 20 >= 200""")
def k1_build_calibration(spark, sf):
    rows = C.build_calibration(exam_rows(spark, sf))
    return rows.select(
        "model_id", F.col("substitution_platt.a").alias("platt_a"), "threshold", F.col("gop_platt.a").alias("gop_a"),
        F.round("hearing_platt.a", 6).alias("hearing_a"), "hearing_threshold")


@query("""WITH n AS (SELECT *, n_nationkey AS k FROM nation), r AS (
  SELECT n_name AS model_id, 'missing generated_by' AS rule FROM n WHERE k % 11 = 3 UNION ALL SELECT n_name, 'threshold outside [0.5, 1]' FROM n WHERE k % 7 = 2
  UNION ALL SELECT n_name, 'unknown key per_l1' FROM n WHERE k % 9 = 4 UNION ALL SELECT n_name, 'schema_version must be 1.0' FROM n WHERE k = 12
  UNION ALL SELECT n_name, 'report not found' FROM n WHERE k % 11 = 3 OR k % 13 = 5
  UNION ALL SELECT n_name, 'report is not ok' FROM n WHERE NOT (k % 11 = 3 OR k % 13 = 5) AND k % 6 = 1
  UNION ALL SELECT n_name, 'threshold differs from report' FROM n WHERE NOT (k % 11 = 3 OR k % 13 = 5) AND k % 6 <> 1 AND k % 7 = 2)
  SELECT *, 'ð' AS target FROM r""")
def k2_validate_calibration(spark, sf):
    n = F.col("n_nationkey")
    base = V.table(spark, sf, "nation")
    by = F.concat(F.lit("reports/"), F.col("n_name"))
    files = base.select(
        F.when(n == 12, "2.0").otherwise("1.0").alias("schema_version"), F.when(n % 11 != 3, by).alias("generated_by"),
        F.col("n_name").alias("model_id"), F.lit("ð").alias("target"), F.array(F.lit("z")).alias("confusions"),
        F.lit("mean").alias("score_variant"), F.when(n % 7 == 2, 0.4).otherwise(0.7).alias("threshold"),
        F.lit(0.8).alias("hearing_threshold"), F.when(n % 9 == 4, "x").alias("per_l1"))
    reports = base.filter(n % 13 != 5).select(
        by.alias("generated_by"), F.when(n % 6 == 1, "pooled-bar-not-met").otherwise("ok").alias("status"), F.lit(0.7).alias("threshold"))
    known = [c for c in files.columns if c != "per_l1"]
    return C.validate_calibration(files, reports, known)


# -- exams --------------------------------------------------------------------------------


P_FIT = "(1.0e0 / (1.0e0 + exp(-(f.a * v.value + f.b))))"


def point_sql(threshold: str) -> str:
    """Counts of the judge at a threshold over rows v with fit f."""
    flag = f"coalesce({P_FIT} >= {threshold}, false)"
    return (f"count(*) FILTER ({flag} AND {POS}) AS tp, count(*) FILTER ({flag} AND NOT {POS}) AS fp, "
            f"count(*) FILTER (NOT {flag} AND {POS}) AS fn")


BAKEOFF_CTE = f"""{V.LI_SPLIT_CTE}, lv AS MATERIALIZED (SELECT split, label, substituted_with, score, variant, value FROM (
    SELECT *, unnest(['mean', 'spike', 'vote', 'gop']) AS variant,
      unnest([CAST(score AS DOUBLE), CAST(spike_score AS DOUBLE), CAST(vote_fraction AS DOUBLE), CAST(gop AS DOUBLE)]) AS value FROM lis)),
  {newton_cte(f"SELECT variant AS g, value AS x, {POS} AS y FROM lv WHERE split = 'cal' AND score IS NOT NULL")}, {GRID_CTE},
  swept AS ({rated(f"SELECT v.variant, t.threshold, {point_sql('t.threshold')} FROM lv v JOIN fit f ON f.g = v.variant, grid100 t WHERE v.split = 'cal' GROUP BY ALL")}),
  picked AS (SELECT variant, threshold, CASE WHEN precision >= 0.9e0 THEN 'ok' ELSE '{K.BAR_NOT_MET}' END AS cal_status FROM swept
    QUALIFY row_number() OVER (PARTITION BY variant ORDER BY precision >= 0.9e0 DESC,
      CASE WHEN precision >= 0.9e0 THEN recall ELSE precision END DESC, threshold DESC) = 1),
  tested AS ({rated(f"SELECT v.variant, {point_sql('k.threshold')} FROM lv v JOIN fit f ON f.g = v.variant JOIN picked k ON k.variant = v.variant WHERE v.split = 'test' GROUP BY ALL")}),
  ranked AS (SELECT variant, y, rank() OVER (PARTITION BY variant ORDER BY p) + (count(*) OVER (PARTITION BY variant, p) - 1) / 2.0e0 AS rk
    FROM (SELECT v.variant, {POS} AS y, {P_FIT} AS p FROM lv v JOIN fit f ON f.g = v.variant WHERE v.split = 'test' AND value IS NOT NULL)),
  areas AS (SELECT variant, CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN
      round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0e0)
        / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) END AS auc FROM ranked GROUP BY variant),
  bake AS (SELECT o.variant, threshold, CASE WHEN f.g IS NULL THEN 'no-scores' WHEN cal_status <> 'ok' THEN cal_status
      WHEN precision >= {K.PRECISION_BAR} AND recall >= {K.RECALL_BAR} THEN 'ok' ELSE 'pooled-bar-not-met' END AS status,
    precision, recall, f1, auc, f.a, f.b FROM (SELECT unnest(['mean', 'spike', 'vote', 'gop']) AS variant) o
    LEFT JOIN fit f ON f.g = o.variant LEFT JOIN picked USING (variant) LEFT JOIN tested USING (variant) LEFT JOIN areas USING (variant))"""


@query(f"WITH RECURSIVE {BAKEOFF_CTE} SELECT * REPLACE (round(a, 4) AS a, round(b, 4) AS b) FROM bake")
def d13_variant_bakeoff(spark, sf):
    return exam.variant_bakeoff(V.li_split(spark, sf)).select(
        "variant", "threshold", "status", "precision", "recall", "f1", "auc", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def mirror_sql(threshold: str) -> str:
    """Mirror counts at a threshold over rows v with fit h."""
    p = "(1.0e0 / (1.0e0 + exp(-(h.a * hearing_score + h.b))))"
    sure = f"(heard IS NOT NULL AND coalesce({p} >= {threshold}, false))"
    return (f"count(*) AS tokens, count(heard) AS scored, count(*) FILTER ({sure}) AS confident, "
            f"count(*) FILTER ({sure} AND heard = {REAL}) AS correct, count(*) FILTER ({sure} AND {REAL} IS NOT NULL) AS sc, "
            f"count(*) FILTER (heard IS NOT NULL AND {REAL} IS NOT NULL) AS rw, count(*) FILTER (heard = {REAL}) AS rc")


HEARING_CTE = f"""cal AS MATERIALIZED (SELECT * FROM lis WHERE split = 'cal'),
  {newton_cte(f"SELECT 'all' AS g, CAST(hearing_score AS DOUBLE) AS x, heard = {REAL} AS y FROM cal WHERE heard IS NOT NULL AND {REAL} IS NOT NULL", "h")},
  hsweep AS (SELECT *, {MIRROR_RATES} FROM (SELECT threshold, {mirror_sql("threshold")} FROM cal, grid100, hfit h GROUP BY threshold)),
  hpick AS (SELECT threshold, CASE WHEN accuracy >= 0.9e0 THEN 'ok' ELSE '{K.BAR_NOT_MET}' END AS cal_status FROM hsweep
    ORDER BY accuracy >= 0.9e0 DESC, CASE WHEN accuracy >= 0.9e0 THEN coverage ELSE accuracy END DESC, threshold DESC LIMIT 1)"""
K8_SQL = f"""WITH RECURSIVE {BAKEOFF_CTE}, {HEARING_CTE},
  {newton_cte(f"SELECT 'all' AS g, CAST(gop AS DOUBLE) AS x, NOT {POS} AS y FROM cal WHERE score IS NOT NULL", "g")},
  htest AS (SELECT *, {MIRROR_RATES} FROM (SELECT {mirror_sql("(SELECT threshold FROM hpick)")} FROM lis, hfit h WHERE split = 'test')),
  best AS (SELECT * FROM bake ORDER BY status = 'ok' DESC, CASE WHEN status = 'ok' THEN f1 ELSE coalesce(auc, -1) END DESC,
    CASE WHEN status = 'ok' THEN recall ELSE 0 END DESC, list_position(['mean', 'spike', 'vote', 'gop'], variant) LIMIT 1)
  SELECT 'm1' AS model_id, 'ð' AS target, 'reports/run.json' AS generated_by, variant AS score_variant, round(best.a, 4) AS platt_a,
    round(best.b, 4) AS platt_b, best.threshold, best.status AS judge_status, precision, recall, f1, auc,
    round(hfit.a, 4) AS hearing_a, round(hfit.b, 4) AS hearing_b, hpick.threshold AS hearing_threshold,
    CASE WHEN cal_status <> 'ok' THEN cal_status WHEN accuracy >= {K.ACCURACY_BAR} AND coverage >= {K.COVERAGE_BAR} THEN 'ok'
      ELSE 'mirror-bar-not-met' END AS hearing_status, accuracy, coverage, round(gfit.a, 4) AS gop_a, round(gfit.b, 4) AS gop_b,
    (SELECT count(*) FROM lis WHERE split = 'train') AS train, (SELECT count(*) FROM cal) AS cal,
    (SELECT count(*) FROM lis WHERE split = 'test') AS test FROM best, hfit, hpick, htest, gfit"""


def examined(spark, sf):
    return exam.run_exam(V.li_split(spark, sf, indexed=True), V.TARGET, V.CONFUSIONS, "m1", "reports/run.json")


def shown(summary):
    rounded = {c: F.round(c, 4) for c in ("platt_a", "platt_b", "hearing_a", "hearing_b", "gop_a", "gop_b")}
    return summary.drop("confusions").withColumns(rounded)


@query(K8_SQL)
def k8_run_exam(spark, sf):
    return shown(examined(spark, sf)["summary"])


def audit_sql(group: str) -> str:
    inner = rated(f"SELECT '{group}' AS grouping, {group} AS name, v.variant, count(*) AS tokens, count(*) FILTER ({POS}) AS positives, "
                  f"count(v.value) AS verdicts, {point_sql('f.threshold')} FROM lw v JOIN bake f ON f.variant = v.variant "
                  "WHERE v.split = 'test' GROUP BY ALL")
    return f"SELECT *, {OK} AS ok FROM ({inner})"


@query(f"""WITH RECURSIVE {BAKEOFF_CTE}, lw AS (SELECT *, unnest(['mean', 'spike', 'vote', 'gop']) AS variant,
      unnest([CAST(score AS DOUBLE), CAST(spike_score AS DOUBLE), CAST(vote_fraction AS DOUBLE), CAST(gop AS DOUBLE)]) AS value FROM lis)
  {audit_sql('l1')} UNION ALL {audit_sql('corpus')}""")
def k8_exam_audits(spark, sf):
    frames = examined(spark, sf)
    parts = [frames[f"audit_{g}"].withColumns({"grouping": F.lit(g), "name": F.col(g)}).drop(g) for g in ("l1", "corpus")]
    return parts[0].unionByName(parts[1]).drop("refused", "audio_problem_refused")


@query(f"""WITH RECURSIVE {BAKEOFF_CTE}, {HEARING_CTE},
  m AS (SELECT *, {MIRROR_RATES} FROM (SELECT l1, {mirror_sql("(SELECT threshold FROM hpick)")} FROM lis, hfit h WHERE split = 'test' GROUP BY l1)),
  c AS (SELECT {REAL} AS realized, heard FROM lis, hfit h WHERE split = 'test' AND heard IS NOT NULL AND {REAL} IS NOT NULL
    AND (1.0e0 / (1.0e0 + exp(-(h.a * hearing_score + h.b)))) >= (SELECT threshold FROM hpick))
  SELECT l1 AS name, NULL AS heard, confident AS n, accuracy, coverage, CASE WHEN confident >= {K.GROUP_MIN} THEN accuracy >= {K.ACCURACY_BAR} AND coverage >= {K.COVERAGE_BAR}
    ELSE confident = 0 OR accuracy >= {K.GROUP_FLOOR} END AS ok FROM m
  UNION ALL SELECT realized, heard, count(*), NULL, NULL, NULL FROM c GROUP BY ALL""")
def k8_exam_mirror(spark, sf):
    """The mirror's audit by first language, and what was heard for what was said."""
    frames = examined(spark, sf)
    none = F.lit(None)
    audit = frames["hearing_audit"].select(
        F.col("l1").alias("name"), none.cast("string").alias("heard"), F.col("confident").alias("n"), "accuracy", "coverage", "ok")
    table = frames["hearing_confusion"].drop("is_target").unpivot("realized", None, "heard", "n").filter("n > 0")
    return audit.unionByName(table.select(
        F.col("realized").alias("name"), "heard", "n", *[none.cast(t).alias(c) for c, t in (
            ("accuracy", "double"), ("coverage", "double"), ("ok", "boolean"))]))


def evaluated(spark, sf, parts: list[str]):
    """The exam from utterances, in one run for each part of the tokens; the records of a part are kept by the next."""
    path = scratch(spark, "records")
    tokens = V.li_indexed(spark, sf).select("utterance_id", "token_index", "phone", "l_orderkey")
    engine = V.li_numbered(spark, sf)

    def analyze(work):
        chosen = engine.join(work.select(*exam.KEYS, "split"), exam.KEYS)
        return with_verdicts(V.li_records(spark, chosen, "split"))

    for part in parts:
        frames = exam.evaluate(
            utterance_rows(spark, sf), tokens.filter(part).drop("l_orderkey"), speaker_roster(spark, sf), analyze, path,
            V.TARGET, V.CONFUSIONS, "m1", "reports/run.json")
    return frames


@query(K8_SQL.replace("FROM lis", "FROM lx").replace(
    f"WITH RECURSIVE {V.LI_SPLIT_CTE}", f"WITH RECURSIVE {V.LI_SPLIT_CTE}, lx AS (SELECT * FROM lis WHERE phone = 'ð' AND split <> 'train')"))
def k8_evaluate(spark, sf):
    """Two runs; the second one has the first half of its tokens recorded already."""
    return shown(evaluated(spark, sf, ["l_orderkey % 2 = 0", "true"])["summary"])


REPORT_SQL = f"""{V.LI_SPLIT_CTE}, lx AS (SELECT * FROM lis WHERE phone = 'ð' AND split <> 'train'),
  al AS (SELECT alignment, count(*) AS n, CASE WHEN alignment = 'ok' THEN round(avg(alignment_confidence), 4) END AS c FROM lx GROUP BY alignment)
  SELECT 'Alignment' AS section, '| ' || alignment || ' | ' || n || ' | ' || coalesce(CAST(c AS VARCHAR), '-') || ' |' AS line FROM al
  UNION ALL SELECT 'Exam', '- tokens: 0 train / ' || count(*) FILTER (split = 'cal') || ' cal / ' || count(*) FILTER (split = 'test') || ' held-out' FROM lx
  UNION ALL SELECT 'lines of ' || s, CAST(n AS VARCHAR) FROM (SELECT unnest(['Exam', 'Mirror', 'Mirror by first language', 'Judge variants',
    'Judge operating point', 'Judge on cal', 'Judge held-out', 'Judge by first language', 'Judge by corpus', 'Alignment', 'Latency']) AS s,
    unnest([6, 7, 3 + (SELECT count(DISTINCT l1) FROM lx WHERE split = 'test'), 7, 4, 3, 5, 3 + (SELECT count(DISTINCT l1) FROM lx WHERE split = 'test'),
      3 + (SELECT count(DISTINCT corpus) FROM lx WHERE split = 'test'), 3 + (SELECT count(*) FROM al), 3]) AS n)"""


@query("WITH " + REPORT_SQL)
def a12_exam_report(spark, sf):
    """The whole report, written and read: its alignment rows, its token counts and the lines of its sections."""
    frames = evaluated(spark, sf, ["true"])
    sinks.write_report(frames["summary"], report.report_lines(frames), path := scratch(spark, "report"))
    text = spark.read.text(f"{path}/report", wholetext=True)
    section = F.explode(F.filter(F.split("value", r"(?m)^## "), lambda s: s != ""))
    parts = text.select(section.alias("s")).select(
        F.substring_index("s", "\n", 1).alias("section"), F.filter(F.split("s", "\n"), lambda x: x != "").alias("lines"))
    rows = parts.select("section", F.posexplode("lines").alias("k", "line"))
    counts = parts.select(F.concat(F.lit("lines of "), "section").alias("section"), F.size("lines").cast("string").alias("line")).filter(
        ~F.col("section").rlike("to listen to|Realised"))
    return rows.filter("(section = 'Alignment' AND k > 2) OR (section = 'Exam' AND line LIKE '- tokens%')").select(
        "section", "line").unionByName(counts)


NAMES = {k: f"p{k}" for k in range(1, 8)}


def takes(spark, sf):
    """Takes to analyse, without their posteriors."""
    return V.post(spark, sf).select(
        F.col("utt").alias("take"), F.lit("m1").alias("model_id"), F.lit("word").alias("text"),
        F.array(F.col("target"), (1 + F.col("target") % 7).cast("int")).alias("targets"), F.lit(0).alias("focus"),
        "confusions", "hop_s", F.lit(0.1).alias("offset_s"), F.lit(0.3).alias("duration_s"),
        (F.col("utt") % 19 != 0).alias("has_speech"), (F.col("utt") % 23 == 1).alias("clipping"),
        F.lit(False).alias("too_quiet"), F.when(F.col("utt") % 3 == 0, "fall").alias("expected_tone"))


def take_posteriors(spark, sf):
    return V.post(spark, sf).select(F.col("utt").alias("take"), "logits")


def take_calibrations(spark, sf):
    """One calibration for each phone that lineitem has often enough, from its whole table."""
    phone = F.concat(F.lit("p"), (1 + F.col("l_partkey") % 7).cast("string")).alias("target")
    held = V.table(spark, sf, "lineitem").groupBy(phone).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    return held.filter("r % 7 <> 0").select(
        F.lit("m1").alias("model_id"), "target", F.lit("mean").alias("score_variant"),
        (0.5 + F.col("n") % 5 / 4.0).alias("platt_a"), (F.col("r") % 3 / 10.0).alias("platt_b"),
        (0.55 + F.col("n") % 4 / 20.0).alias("threshold"), F.lit(1.0).alias("gop_a"), F.lit(2.0).alias("gop_b"),
        F.lit(1.0).alias("hearing_a"), F.lit(0.0).alias("hearing_b"), F.lit(0.6).alias("hearing_threshold"))


ANALYSIS_CTE = f"""{V.POST_CTE}, {V.path_cte(["target", "1 + target % 7"])},
  calib AS (SELECT 'p' || (1 + l_partkey % 7) AS target, 0.5e0 + count(*) % 5 / 4.0e0 AS a, count(*) FILTER (l_returnflag = 'R') % 3 / 10.0e0 AS b,
    0.55e0 + count(*) % 4 / 20.0e0 AS threshold FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') % 7 <> 0),
  lf AS (SELECT utt, t, (s - 1) // 2 AS idx FROM path WHERE s % 2 = 1),
  ph AS (SELECT lf.utt, idx, greatest(0, least(1, exp(avg(mx)))) AS sure FROM lf JOIN (SELECT utt, t, max(logp) AS mx FROM logp GROUP BY ALL) f
    ON f.utt = lf.utt AND f.t = lf.t GROUP BY ALL),
  su AS (SELECT utt, round(avg(sure), 9) AS sure, count(*) AS phones FROM ph GROUP BY utt),
  al AS (SELECT p.utt, target, p.klass, phones, CASE WHEN p.utt % 19 = 0 OR p.utt % 23 = 1 OR sure < {K.MIN_ALIGNMENT} THEN 'failed'
      WHEN sure < {K.LOW_ALIGNMENT} THEN 'low_confidence' ELSE 'ok' END AS alignment,
    CASE WHEN p.utt % 19 = 0 THEN '{K.NO_SPEECH}' WHEN p.utt % 23 = 1 THEN '{K.CLIPPING}' WHEN sure < {K.MIN_ALIGNMENT} THEN '{K.BELOW_FLOOR}' END AS reason
    FROM post0 p LEFT JOIN su ON su.utt = p.utt),
  fm AS (SELECT l.utt, l.token, avg(exp(logp)) AS m FROM logp l JOIN lf ON lf.utt = l.utt AND lf.t = l.t AND idx = 0 GROUP BY ALL),
  sc AS (SELECT al.utt, ln((max(m) FILTER (k > 0) / (sum(m) + 1e-12) + 1e-12) / (max(m) FILTER (k = 0) / (sum(m) + 1e-12) + 1e-12)) AS score
    FROM al, (SELECT unnest([0, 1, 2, 3]) AS k), fm WHERE fm.utt = al.utt AND fm.token = CASE WHEN k = 0 THEN target ELSE 1 + (klass % 7 + k) % 7 END GROUP BY al.utt),
  hd AS (SELECT utt, arg_max(token, m) AS heard FROM fm WHERE token > 0 GROUP BY utt),
  matched AS (SELECT al.*, heard, sc.score, a, b, threshold FROM al LEFT JOIN sc ON sc.utt = al.utt LEFT JOIN hd ON hd.utt = al.utt
    LEFT JOIN calib c ON c.target = 'p' || al.target),
  rec AS (SELECT utt AS take, alignment, reason, CASE WHEN alignment = 'ok' THEN {VERDICT} END AS verdict,
    CASE WHEN alignment = 'ok' THEN 'p' || heard END AS heard, coalesce(reason IN ('{K.NO_SPEECH}', '{K.CLIPPING}'), false) AS audio_problem,
    CASE WHEN alignment <> 'failed' THEN phones END AS phones FROM matched)"""


@query()
def k7_analyze(spark, sf):
    given = takes(spark, sf).join(take_posteriors(spark, sf), "take")
    rows = analysis.analyze(given, semis(spark, sf), take_calibrations(spark, sf), NAMES)
    return rows.select(
        "take", "alignment.status", "alignment.reason", F.size("alignment.phones").alias("phones"),
        F.get("contrasts", F.lit(0))["verdict"].alias("verdict"), F.get("contrasts", F.lit(0))["heard"].alias("heard"),
        F.col("nuclear_tone.detected").alias("tone"), F.to_json("feedback").alias("feedback"))


@query(f"""WITH {ANALYSIS_CTE}, {TONE_CTE} SELECT take, alignment, reason, phones, verdict, heard, tone
  FROM rec LEFT JOIN tn ON tn.clip = rec.take""")
def k7_analysis_fields(spark, sf):
    return k7_analyze(spark, sf).withColumnRenamed("status", "alignment").drop("feedback")


# -- streams ---------------------------------------------------------------------------------


class Lost(Exception):
    """Stands for a driver that is lost at a certain point."""


def lose(number: int) -> None:
    raise Lost(number)


def finish(run) -> bool:
    """Wait for a stream; false if it was lost."""
    try:
        run.awaitTermination()
        return True
    except StreamingQueryException:
        return False


def arrivals(spark, rows, part, source):
    """Write the rows of one delivery to a folder."""
    rows.filter(part).write.mode("append").parquet(source)


@query(f"WITH {ANALYSIS_CTE} SELECT take, alignment, reason, audio_problem, verdict, heard, CAST(1 AS BIGINT) AS analyses FROM rec")
def l1_stream_exam(spark, sf):
    """Three deliveries, which overlap by a third; the second run is lost after its write."""
    source, out, state = (scratch(spark, n) for n in ("source", "records", "state"))
    rows, posteriors = takes(spark, sf), take_posteriors(spark, sf)
    tracks, calib = settle(semis(spark, sf)), settle(take_calibrations(spark, sf))
    analyze = lambda work: analysis.analyze_tokens(work, posteriors, tracks, calib, NAMES)
    for turn, written in enumerate([None, lose, None, None]):
        if turn < 3:
            arrivals(spark, rows, (F.col("take") % 3 == turn) | (F.col("take") % 9 == 8), source)
        tokens = L.read_stream(spark, source, rows.schema, "parquet")
        finish(L.stream_exam(tokens, analyze, ["take"], out, state, written))
    found = L.exam_records(spark, out)
    return found.groupBy("take", "alignment", "reason", "audio_problem", "verdict", "heard").agg(F.count("*").alias("analyses"))


def stream(spark, sf):
    schema = V.table(spark, sf, "lineitem").schema
    return L.read_stream(spark, sf, schema, "parquet", "lineitem.parquet")


@query("SELECT l_returnflag AS label, count(*) AS n, CAST(0 AS BIGINT) AS repeated FROM lineitem GROUP BY l_returnflag")
def l1_stream_records(spark, sf):
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    score = lambda df: df.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"))
    sizes = []
    for _ in range(2):  # the second run resumes from the checkpoint and finds nothing new
        L.stream_records(stream(spark, sf), score, out, state).awaitTermination()
        sizes.append(spark.read.parquet(out).count())
    rows = spark.read.parquet(out)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.lit(sizes[1] - sizes[0]).cast("bigint").alias("repeated"))


@query("SELECT l_linenumber, count(DISTINCT l_orderkey) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS state_rows "
       "FROM lineitem GROUP BY l_linenumber")
def l2_stream_dedupe(spark, sf):
    """Two deliveries with a third in common; state is on disk."""
    source, out, state = (scratch(spark, n) for n in ("source", "stream", "state"))
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    for part in ("l_orderkey % 3 < 2", "l_orderkey % 3 > 0"):
        arrivals(spark, rows, part, source)
        once = L.stream_dedupe(L.read_stream(spark, source, rows.schema, "parquet"), rows.columns).select(*rows.columns)
        with L.disk_state(spark):
            run = L.stream_records(once, lambda df: df, out, state)
        run.awaitTermination()
    held = L.state_size(run)["rows"]
    return spark.read.parquet(out).groupBy("l_linenumber").agg(
        F.count("*").alias("n"), F.lit(held).cast("bigint").alias("state_rows"))


@query("SELECT l_linestatus AS alignment, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def l3_stream_status(spark, sf):
    """Counters over three deliveries; the second run is lost after its write and repeated."""
    source, out, state = (scratch(spark, n) for n in ("source", "counters", "state"))
    rows = V.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("alignment"))
    for turn, written in enumerate([None, lose, None, None]):
        if turn < 3:
            arrivals(spark, rows, F.col("l_orderkey") % 3 == turn, source)
        counters = L.stream_status(L.read_stream(spark, source, rows.schema, "parquet"))
        finish(L.stream_counters(counters, out, state, written))
    return L.read_counters(spark, out)


# -- sinks -----------------------------------------------------------------------------------


@query(f"WITH {V.LI_SPLIT_CTE} SELECT split, count(*) AS n FROM lis GROUP BY split")
def a8_append_records(spark, sf):
    path = scratch(spark, "records")
    rows = with_verdicts(V.li_split(spark, sf, indexed=True)).select(*[f.name for f in schemas.TOKEN_RECORD])
    for part in ("split = 'train'", "split <> 'train'"):
        sinks.append_records(rows.filter(part), path)
    return corpora.read_records(spark, path).groupBy("split").agg(F.count("*").alias("n"))


def export_table(spark, sf):
    rows = exported(spark, sf).filter(F.col("class").isNotNull())
    return rows.select(
        F.col("audio_path").alias("filename"), F.col("class").alias("label"), "l1", "utterance_id",
        F.col("l_linenumber").alias("token_index"), F.col("phone").alias("target_phone"), "start_s",
        F.round("end_s", 4).alias("end_s"), F.round(F.col("end_s") - F.col("start_s"), 4).alias("duration_s"), "split")


@query(f"WITH {V.LI_CTE}, {EXPORT_CTE} SELECT split, class AS label, count(*) AS n, 2 AS sources FROM ex WHERE class IS NOT NULL GROUP BY ALL")
def a9_read_labels(spark, sf):
    dirs = [scratch(spark, "export"), scratch(spark, "export")]
    rows = export_table(spark, sf)
    for k, d in enumerate(dirs):
        sinks.write_labels(rows.filter(F.col("token_index") % 2 == k), {"seed": 42}, d)
    back = corpora.read_labels(spark, dirs)
    return back.groupBy("split", "label").agg(F.count("*").alias("n"), F.countDistinct("source").cast("int").alias("sources"))


@query(f"""WITH {V.LI_CTE}, {EXPORT_CTE} SELECT 42 AS seed, count(*) FILTER (class = 'ð') AS target_rows, count(*) FILTER (split = 'val') AS val_rows FROM ex WHERE class IS NOT NULL""")
def a10_write_labels(spark, sf):
    path = scratch(spark, "export")
    sinks.write_labels(export_table(spark, sf), {"seed": 42, "pad_s": 0.1}, path)
    text = spark.read.text(f"{path}/manifest")
    fact = F.from_json("value", "seed INT, class_counts MAP<STRING, BIGINT>, split_counts MAP<STRING, BIGINT>")
    return text.select(fact.alias("m")).select(
        "m.seed", F.col("m.class_counts")["ð"].alias("target_rows"), F.col("m.split_counts")["val"].alias("val_rows"))


@query(f"""WITH {V.LI_CTE}, t AS (SELECT alignment, count(*) AS n FROM li0 GROUP BY alignment)
  SELECT '| ' || alignment || ' | ' || n || ' |' AS line FROM t UNION ALL SELECT '## Alignment' UNION ALL SELECT '| alignment | n |' UNION ALL SELECT '|---|---|'""")
def a12_write_report(spark, sf):
    path = scratch(spark, "report")
    stats = M.status_stats(V.li(spark, sf))
    lines = sinks.markdown_rows(stats, ["alignment", "n"], "Alignment", 1, F.concat(F.lit("a"), "alignment"))
    sinks.write_report(stats, lines, path)
    return spark.read.text(f"{path}/report").select(F.col("value").alias("line"))
