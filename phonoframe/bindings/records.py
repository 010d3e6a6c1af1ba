"""Queries over token records, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.bindings import views as V
from phonoframe.operators import calibrate as C
from phonoframe.operators import metrics as M
from phonoframe.operators import splits as S

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


POS = "(label IN ('substituted', 'deleted'))"


def sig(a, b, x):
    return f"(1.0e0 / (1.0e0 + exp(-({a} * {x} + {b}))))"


def judge(value="score", a=V.A, b=V.B, thr=V.THR):
    """Count and rate columns of the judge at one operating point."""
    flag = f"coalesce({sig(f'{a}e0', f'{b}e0', value)} >= {thr}, false)"
    return f"""count(*) AS tokens, count(*) FILTER ({POS}) AS positives,
      count({value}) AS verdicts, count(*) - count({value}) AS refused,
      count(*) FILTER (audio_problem) AS audio_problem_refused,
      count(*) FILTER ({flag} AND {POS}) AS tp, count(*) FILTER ({flag} AND NOT {POS}) AS fp,
      count(*) FILTER (NOT {flag} AND {POS}) AS fn"""


RATES = """CASE WHEN tp + fp > 0 THEN tp * 1.0e0 / (tp + fp) ELSE 0.0e0 END AS p0,
      CASE WHEN tp + fn > 0 THEN tp * 1.0e0 / (tp + fn) ELSE 0.0e0 END AS r0"""
FINAL = """round(p0, 4) AS precision, round(r0, 4) AS recall,
      CASE WHEN p0 + r0 > 0 THEN round(2 * p0 * r0 / (p0 + r0), 4) ELSE 0.0e0 END AS f1"""


def rated(inner: str, extra: str = "*") -> str:
    return f"SELECT * EXCLUDE (p0, r0), {FINAL} FROM (SELECT *, {RATES} FROM ({inner}))"


OK = f"""CASE WHEN positives >= {K.GROUP_MIN} THEN precision >= {K.PRECISION_BAR} AND recall >= {K.RECALL_BAR}
      ELSE positives = 0 OR precision >= {K.GROUP_FLOOR} END"""
GRID_CTE = "grid100 AS (SELECT CAST(unnest([%s]) AS DOUBLE) AS threshold)" % ", ".join(
    str(t) for t in K.THRESHOLDS)


# -- record scalars -------------------------------------------------------------------


@query(f"WITH {V.LI_CTE} SELECT audio_path, CASE label WHEN 'correct' THEN 'ð' WHEN 'deleted' THEN '∅' "
       "ELSE substituted_with END AS realized FROM li0")
def b9_realized_of(spark, sf):
    return V.li(spark, sf).select("audio_path", M.realized_of(V.TARGET).alias("realized"))


@query(f"""WITH {V.LI_CTE}, v AS (SELECT audio_path, unnest(['mean', 'spike', 'vote', 'gop', 'hearing']) AS variant,
  unnest([score, spike_score, vote_fraction, gop, hearing_score]) AS x FROM li0)
  SELECT variant, count(*) AS n, count(x) AS scored, round(avg({sig('1.5e0', '0.25e0', 'x')}), 6) AS mean_p
  FROM v GROUP BY variant""")
def b11_platt_prob(spark, sf):
    names = F.array(*[F.lit(v) for v in C.VARIANTS])
    rows = V.li(spark, sf).withColumn("variant", F.explode(names))
    p = C.platt_prob(F.col("variant"), 1.5, 0.25)
    return rows.groupBy("variant").agg(
        F.count("*").alias("n"), F.count(p).alias("scored"), F.round(F.avg(p), 6).alias("mean_p"))


def calibrations(spark, sf):
    """A calibration table derived from the regions: one row per model, some without a fit."""
    return V.table(spark, sf, "region").select(
        F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model_id"),
        F.lit("ð").alias("target"),
        F.when(F.col("r_regionkey") != 2, 1.0 + F.col("r_regionkey") / 4.0).alias("a"),
        F.when(F.col("r_regionkey") != 2, F.lit(0.1)).alias("b"),
        F.when(F.col("r_regionkey") != 2, 0.6 + F.col("r_regionkey") / 20.0).alias("threshold"))


CALIB_CTE = """calib AS (SELECT 'm' || r_regionkey AS model_id, 'ð' AS target,
  CASE WHEN r_regionkey <> 2 THEN 1.0e0 + r_regionkey / 4.0e0 END AS a,
  CASE WHEN r_regionkey <> 2 THEN 0.1e0 END AS b,
  CASE WHEN r_regionkey <> 2 THEN 0.6e0 + r_regionkey / 20.0e0 END AS threshold FROM region),
  toks AS (SELECT *, 'm' || (l_partkey % 7) AS model_id, phone AS target FROM li0),
  matched AS (SELECT toks.*, a, b, threshold FROM toks LEFT JOIN calib
              ON toks.model_id = calib.model_id AND toks.target = calib.target)"""


def with_calibration(spark, sf, rows=None):
    tokens = (rows or V.li(spark, sf)).withColumns(
        {"model_id": F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")),
         "target": F.col("phone")})
    return C.match_calibration(tokens, calibrations(spark, sf))


VERDICT = f"""CASE WHEN score IS NULL OR a IS NULL OR threshold IS NULL THEN 'uncertain'
  WHEN {sig('a', 'b', 'score')} >= threshold THEN 'substituted'
  WHEN {sig('a', 'b', 'score')} <= 1.0e0 - threshold THEN 'on_target' ELSE 'uncertain' END"""


@query(f"""WITH {V.LI_CTE}, {CALIB_CTE} SELECT audio_path, {VERDICT} AS verdict,
  CASE WHEN score IS NULL OR a IS NULL THEN 0.0e0 ELSE round({sig('a', 'b', 'score')}, 4) END AS confidence,
  CASE WHEN {VERDICT} = 'substituted' THEN best_confusion END AS detected FROM matched""")
def b12_decide(spark, sf):
    rows = with_calibration(spark, sf).withColumn("d", C.decide("score", "a", "b", "threshold"))
    return rows.select(
        "audio_path", "d.verdict", F.round("d.confidence", 4).alias("confidence"),
        F.when(F.col("d.is_detected"), F.col("best_confusion")).alias("detected"))


@query(f"""WITH {V.LI_CTE}, {CALIB_CTE} SELECT model_id, target, count(*) AS n, count(a) AS matched
  FROM matched GROUP BY model_id, target""")
def c11_match_calibration(spark, sf):
    return with_calibration(spark, sf).groupBy("model_id", "target").agg(
        F.count("*").alias("n"), F.count("a").alias("matched"))


@query(f"""WITH {V.LI_CTE}, {CALIB_CTE} SELECT audio_path, CASE WHEN l_linenumber = 1 AND a IS NOT NULL
  THEN round({sig('a', 'b', 'gop')}, 4) END AS phone_score FROM matched""")
def k5_phone_score(spark, sf):
    return with_calibration(spark, sf).select(
        "audio_path", C.phone_score("gop", F.col("l_linenumber") == 1, "a", "b").alias("phone_score"))


# -- judge metrics -----------------------------------------------------------------------


@query(f"WITH {V.LI_CTE} " + rated(f"SELECT l1, {judge()} FROM li0 GROUP BY l1"))
def d1_metrics_by_l1(spark, sf):
    return M.score_metrics(V.li(spark, sf), V.A, V.B, V.THR, by=["l1"])


@query(f"WITH {V.LI_CTE}, m AS (" + rated(
    f"SELECT coalesce(l1, 'ALL') AS l1, {judge()} FROM li0 GROUP BY GROUPING SETS ((l1), ())")
    + f") SELECT *, {OK} AS ok FROM m")
def d2_audit_by_l1(spark, sf):
    return M.audit(V.li(spark, sf), V.A, V.B, V.THR, "l1")


@query(f"WITH {V.LI_CTE}, m AS (" + rated(f"SELECT corpus, {judge()} FROM li0 GROUP BY corpus")
       + ") SELECT corpus, precision, recall, CASE WHEN corpus = 'open' AND positives = 0 THEN 'x' "
       "WHEN precision >= 0.9 AND recall >= 0.4 THEN 'ok' ELSE 'pooled-bar-not-met' END AS status FROM m")
def d3_final_status(spark, sf):
    rows = M.score_metrics(V.li(spark, sf), V.A, V.B, V.THR, by=["corpus"])
    return rows.select("corpus", "precision", "recall", M.final_status(F.lit("ok")).alias("status"))


def auc_sql(rows: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""r AS (SELECT {keys}y, rank() OVER ({part} ORDER BY x)
        + (count(*) OVER ({part}{',' if by else 'PARTITION BY'} x) - 1) / 2.0e0 AS rk FROM ({rows}))
      SELECT {keys}count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
        CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN
        round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0e0)
          / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) END AS auc FROM r {group}"""


AUC_BY = """r AS (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY x)
    + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0e0 AS rk FROM ({rows}))
  SELECT g AS {by}, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives,
    CASE WHEN count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0 THEN
    round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0e0)
      / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 4) END AS auc FROM r GROUP BY g"""


@query(f"WITH {V.LI_CTE}, " + AUC_BY.format(
    rows=f"SELECT l1 AS g, vote_fraction AS x, {POS} AS y FROM li0 WHERE vote_fraction IS NOT NULL", by="l1"))
def d4_auc_by_l1(spark, sf):
    return M.auc(V.li(spark, sf), "vote_fraction", M.is_positive(), ["l1"])


@query(f"WITH {V.LI_CTE}, " + AUC_BY.format(
    rows=f"SELECT 'pool' AS g, score AS x, {POS} AS y FROM li0 WHERE score IS NOT NULL", by="pool"))
def d4_auc_pooled(spark, sf):
    return M.auc(V.li(spark, sf).withColumn("pool", F.lit("pool")), "score", M.is_positive(), ["pool"])


def newton_cte(rows: str, tag: str = "") -> str:
    """Grouped Newton fit as a recursive CTE over distinct scores: fit(g, n, a, b), names tagged."""
    p = "(1.0e0 / (1.0e0 + exp(-(s.a * d.x + s.b))))"
    return f"""{tag}d AS MATERIALIZED (SELECT g, x, count(*)::DOUBLE AS n, count(*) FILTER (y)::DOUBLE AS y
      FROM ({rows}) WHERE x IS NOT NULL GROUP BY g, x),
    {tag}steps(g, i, a, b) AS (
      SELECT DISTINCT g, 0, 0.0e0, 0.0e0 FROM {tag}d
      UNION ALL
      SELECT g, i + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
             b + (haa * gb - hab * ga) / (haa * hbb - hab * hab)
      FROM (SELECT s.g, s.i, s.a, s.b, sum(d.x * (d.y - d.n * {p})) AS ga, sum(d.y - d.n * {p}) AS gb,
              sum(d.n * {p} * (1 - {p}) * d.x * d.x) AS haa, sum(d.n * {p} * (1 - {p}) * d.x) AS hab,
              sum(d.n * {p} * (1 - {p})) AS hbb
            FROM {tag}steps s JOIN {tag}d d ON s.g = d.g WHERE s.i < 15 GROUP BY s.g, s.i, s.a, s.b)),
    {tag}fit AS (SELECT s.g, n, a, b FROM {tag}steps s JOIN (SELECT g, sum(n) AS n FROM {tag}d GROUP BY g) z
            ON s.g = z.g WHERE i = 15)"""


@query(f"WITH RECURSIVE {V.LI_CTE}, " + newton_cte(f"SELECT l1 AS g, score AS x, {POS} AS y FROM li0")
       + " SELECT g AS l1, CAST(n AS BIGINT) AS n, round(a, 4) AS a, round(b, 4) AS b FROM fit")
def d5_fit_platt_by_l1(spark, sf):
    fit = C.fit_platt(V.li(spark, sf), "score", M.is_positive(), ["l1"])
    return fit.select("l1", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"WITH RECURSIVE {V.LI_CTE}, " + newton_cte(f"SELECT corpus AS g, gop AS x, NOT {POS} AS y FROM li0")
       + " SELECT g AS corpus, CAST(n AS BIGINT) AS n, round(a, 4) AS a, round(b, 4) AS b FROM fit")
def d5_fit_gop_inverted(spark, sf):
    fit = C.fit_platt(V.li(spark, sf), "gop", ~M.is_positive(), ["corpus"])
    return fit.select("corpus", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def sweep_sql(g: str, cte: str) -> str:
    flag = f"coalesce({sig('1.5e0', '0.0e0', 'score')} >= threshold, false)"
    inner = f"""SELECT {g} AS g, threshold, count(*) AS tokens, count(*) FILTER ({POS}) AS positives,
      count(score) AS verdicts, count(*) FILTER (audio_problem) AS audio_problem_refused,
      count(*) FILTER ({flag} AND {POS}) AS tp, count(*) FILTER ({flag} AND NOT {POS}) AS fp,
      count(*) - count(score) AS refused, count(*) FILTER (NOT {flag} AND {POS}) AS fn
      FROM li0, grid100 GROUP BY {g}, threshold"""
    return f"""WITH {cte}, {GRID_CTE}, m AS ({rated(inner)}), best AS (SELECT *, row_number() OVER (PARTITION BY g
      ORDER BY precision >= 0.9e0 DESC, CASE WHEN precision >= 0.9e0 THEN recall ELSE precision END DESC,
      threshold DESC) AS rn FROM m)
      SELECT * EXCLUDE (rn, g), g AS {g}, CASE WHEN precision >= 0.9e0 THEN 'ok' ELSE '{K.BAR_NOT_MET}' END AS status
      FROM best WHERE rn = 1"""


@query(sweep_sql("l1", V.LI_CTE))
def d6_threshold_sweep_by_l1(spark, sf):
    return M.pick_threshold(V.li(spark, sf), V.A, V.B, by=["l1"])


@query(sweep_sql("corpus", V.LI_CTE))
def d6_threshold_sweep_by_corpus(spark, sf):
    return M.pick_threshold(V.li(spark, sf), V.A, V.B, by=["corpus"])


# -- mirror metrics -------------------------------------------------------------------------

REAL = "(CASE label WHEN 'correct' THEN 'ð' WHEN 'deleted' THEN '∅' ELSE substituted_with END)"


def mirror(thr) -> str:
    sure = f"(heard IS NOT NULL AND coalesce({sig('1.2e0', '0.1e0', 'hearing_score')} >= {thr}, false))"
    return f"""count(*) AS tokens, count(heard) AS scored, count(*) FILTER ({sure}) AS confident,
      count(*) FILTER ({sure} AND heard = {REAL}) AS correct,
      count(*) FILTER ({sure} AND {REAL} IS NOT NULL) AS sc, count(*) FILTER (heard IS NOT NULL AND {REAL} IS NOT NULL) AS rw,
      count(*) FILTER (heard = {REAL}) AS rc"""


MIRROR_RATES = """CASE WHEN sc > 0 THEN round(correct * 1.0e0 / sc, 4) ELSE 0.0e0 END AS accuracy,
  CASE WHEN tokens > 0 THEN round(confident * 1.0e0 / tokens, 4) ELSE 0.0e0 END AS coverage,
  CASE WHEN scored > 0 THEN round(confident * 1.0e0 / scored, 4) ELSE 0.0e0 END AS answer_rate,
  confident - sc AS unscorable, CASE WHEN rw > 0 THEN round(rc * 1.0e0 / rw, 4) ELSE 0.0e0 END AS top1_accuracy"""


@query(f"WITH {V.LI_CTE} SELECT * EXCLUDE (sc, rw, rc), {MIRROR_RATES} FROM "
       f"(SELECT l1, {mirror(V.HTHR)} FROM li0 GROUP BY l1)")
def d7_hearing_metrics_by_l1(spark, sf):
    return M.hearing_metrics(V.li(spark, sf), V.TARGET, V.HA, V.HB, V.HTHR, ["l1"])


@query(f"""WITH {V.LI_CTE}, {GRID_CTE}, m AS (SELECT *, {MIRROR_RATES} FROM
  (SELECT l1, threshold, {mirror('threshold')} FROM li0, grid100 GROUP BY l1, threshold)),
  best AS (SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY accuracy >= 0.9e0 DESC,
    CASE WHEN accuracy >= 0.9e0 THEN coverage ELSE accuracy END DESC, threshold DESC) AS rn FROM m)
  SELECT * EXCLUDE (sc, rw, rc, rn), CASE WHEN accuracy >= 0.9e0 THEN 'ok' ELSE '{K.BAR_NOT_MET}' END AS status,
   CASE WHEN accuracy < 0.9e0 THEN '{K.BAR_NOT_MET}' WHEN coverage >= 0.4e0 THEN 'ok' ELSE 'mirror-bar-not-met' END AS final
  FROM best WHERE rn = 1""")
def d8_hearing_sweep_by_l1(spark, sf):
    picked = M.pick_hearing_threshold(V.li(spark, sf), V.TARGET, V.HA, V.HB, ["l1"])
    return picked.withColumn("final", M.hearing_status("status"))


@query(f"""WITH {V.LI_CTE}, m AS (SELECT * EXCLUDE (sc, rw, rc), {MIRROR_RATES} FROM
  (SELECT corpus, l1, {mirror(V.HTHR)} FROM li0 GROUP BY corpus, l1))
  SELECT *, CASE WHEN confident >= 5 THEN accuracy >= 0.9e0 AND coverage >= 0.4e0
    ELSE confident = 0 OR accuracy >= 0.8e0 END AS ok FROM m""")
def d9_hearing_audit(spark, sf):
    return M.hearing_audit(V.li(spark, sf), V.TARGET, V.HA, V.HB, V.HTHR, ["corpus", "l1"])


HEARD = ["d", "v", "z", "ð", "θ"]


@query(f"""WITH {V.LI_CTE}, c AS (SELECT {REAL} AS realized, heard FROM li0 WHERE heard IS NOT NULL
  AND {REAL} IS NOT NULL AND {sig('1.2e0', '0.1e0', 'hearing_score')} >= {V.HTHR})
  SELECT realized, realized = 'ð' AS is_target, """
       + ", ".join(f"count(*) FILTER (heard = '{h}') AS \"{h}\"" for h in HEARD)
       + " FROM c GROUP BY realized")
def d10_confusion(spark, sf):
    return M.confusion(V.li(spark, sf), V.TARGET, V.HA, V.HB, V.HTHR, HEARD)


# -- run health ----------------------------------------------------------------------------


@query(f"""WITH {V.LI_CTE} SELECT alignment, count(*) AS n,
  CASE WHEN alignment = 'ok' THEN round(avg(alignment_confidence), 4) END AS mean_ok_confidence
  FROM li0 GROUP BY alignment""")
def d11_status_stats(spark, sf):
    return M.status_stats(V.li(spark, sf))


@query(f"""WITH {V.LI_CTE} SELECT
  (SELECT round(wall_ms, 1) FROM li0 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1) AS cold_ms,
  (SELECT round(median(wall_ms), 1) FROM li0 WHERE score IS NOT NULL AND wall_ms > 0) AS median_warm_ms""")
def d12_latency(spark, sf):
    return M.latency(V.li(spark, sf), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(f"""WITH {V.LI_SPLIT_CTE} SELECT count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'cal') AS cal, count(*) FILTER (split = 'test') AS test, 'ok' AS status,
  count(*) FILTER (split = 'cal') >= 200 AS commit FROM lis""")
def d32_commit_gate(spark, sf):
    return M.commit_gate(V.li_split(spark, sf), "ok")


@query(f"WITH {V.LI_CTE}, m AS (" + rated(
    f"SELECT 'm' || (l_suppkey % 12) AS model_id, {judge()} FROM li0 GROUP BY 1")
    + """), s AS (SELECT model_id, precision, recall, f1, CASE WHEN precision >= 0.9e0 AND recall >= 0.4e0
    THEN 'ok' ELSE 'pooled-bar-not-met' END AS status FROM m)
    SELECT *, model_id = (SELECT model_id FROM s WHERE status = 'ok' ORDER BY f1 DESC, precision DESC,
      model_id LIMIT 1) IS TRUE AS winner FROM s""")
def d14_model_bakeoff(spark, sf):
    rows = V.li(spark, sf).withColumn("model_id", F.concat(F.lit("m"), (F.col("l_suppkey") % 12).cast("string")))
    rated_rows = M.score_metrics(rows, V.A, V.B, V.THR, by=["model_id"])
    return M.model_bakeoff(rated_rows.select(
        "model_id", "precision", "recall", "f1", M.final_status(F.lit("ok")).alias("status")))


@query(f"""WITH {V.LI_CTE}, o AS (SELECT l1, {POS} AS y, row_number() OVER (PARTITION BY l1 ORDER BY score DESC, {POS} DESC) AS rk,
  sum(CASE WHEN {POS} THEN 1 ELSE 0 END) OVER (PARTITION BY l1 ORDER BY score DESC, {POS} DESC ROWS UNBOUNDED PRECEDING) AS tp,
  count(*) FILTER ({POS}) OVER (PARTITION BY l1) AS n FROM li0 WHERE score IS NOT NULL)
  SELECT l1, CAST(max(n) AS BIGINT) AS positives, round(max(tp * 1.0e0 / rk) FILTER (rk = fr), 4) AS precision FROM
   (SELECT *, min(rk) FILTER (tp >= 0.4e0 * n) OVER (PARTITION BY l1) AS fr FROM o) GROUP BY l1""")
def d29_precision_at_recall(spark, sf):
    return M.precision_at_recall(V.li(spark, sf), "score", M.is_positive(), 0.4, ["l1"])


# -- splits and samples --------------------------------------------------------------------


@query(f"WITH {V.LI_SPLIT_CTE} SELECT corpus, l1, split, count(*) AS n, count(DISTINCT utterance_id) AS utterances "
       "FROM lis GROUP BY ALL")
def i10_assign_split(spark, sf):
    rows = V.li_split(spark, sf)
    return rows.groupBy("corpus", "l1", "split").agg(
        F.count("*").alias("n"), F.countDistinct("utterance_id").alias("utterances"))


@query(f"""WITH {V.ANN_CTE}, b AS (SELECT block, row_number() OVER (ORDER BY md5('42:blocks:' || block)) AS rk,
  count(*) OVER () AS n FROM (SELECT DISTINCT block FROM ann))
  SELECT block, CASE WHEN rk <= greatest(1, n // 5) THEN 'test' WHEN rk <= 2 * greatest(1, n // 5) THEN 'cal'
  ELSE 'train' END AS split FROM b""")
def i11_split_blocks(spark, sf):
    return S.split_blocks(V.ann(spark, sf))


@query(f"""WITH {V.LI_CTE} SELECT DISTINCT utterance_id,
  {V.bucket_sql("concat_ws(':', '42', 'val', utterance_id)")} < 15 AS is_val FROM li0""")
def i12_val_flag(spark, sf):
    return V.li(spark, sf).select("utterance_id", S.val_flag("utterance_id").alias("is_val")).distinct()


@query(f"""WITH {V.LI_SPLIT_CTE} SELECT speaker, min(split) AS first_split, max(split) AS last_split FROM lis
  WHERE speaker IS NOT NULL GROUP BY speaker HAVING count(DISTINCT split) > 1""")
def j3_leakage_speakers(spark, sf):
    return S.leakage(V.li_split(spark, sf), "speaker")


@query(f"""WITH {V.LI_SPLIT_CTE} SELECT speaker, min(split) AS first_split, max(split) AS last_split FROM lis
  WHERE speaker IS NOT NULL AND corpus = 'open' GROUP BY speaker HAVING count(DISTINCT split) > 1""")
def j3_leakage_open_corpus(spark, sf):
    return S.leakage(V.li_split(spark, sf).filter("corpus = 'open'"), "speaker")


@query(f"""WITH {V.LI_INDEXED_SPLIT_CTE} SELECT utterance_id, token_index, l1, score FROM lis
  WHERE split = 'train' AND label = 'correct' AND score IS NOT NULL AND l1 = 'asia'
  ORDER BY score DESC, utterance_id, token_index LIMIT 200""")
def i1_hard_negatives(spark, sf):
    rows = S.hard_negatives(V.li_split(spark, sf, indexed=True), 200, "asia")
    return rows.select("utterance_id", "token_index", "l1", "score")


@query(f"""WITH {V.LI_INDEXED_CTE}, f AS (SELECT *, {sig('1.5e0', '0.0e0', 'score')} AS p FROM li
    WHERE {sig('1.5e0', '0.0e0', 'score')} >= {V.THR}),
  a AS (SELECT *, '' AS place, 0 AS tier FROM f WHERE NOT {POS} ORDER BY utterance_id, token_index LIMIT 15),
  b AS (SELECT *, md5(concat_ws(':', '42', utterance_id, CAST(token_index AS VARCHAR))) AS place, 1 AS tier FROM f WHERE {POS}
        ORDER BY place, utterance_id, token_index LIMIT 30),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT utterance_id, token_index, l1, start_s, end_s, label AS corpus_label, best_confusion AS predicted_confusion,
    round(p, 4) AS p_substituted, {POS} AS correct_flag FROM u ORDER BY tier, place, utterance_id, token_index LIMIT 30""")
def i2_flagged_sample(spark, sf):
    return S.flagged_sample(V.li_indexed(spark, sf), V.A, V.B, V.THR)


@query(f"""WITH {V.LI_INDEXED_CTE}, f AS (SELECT *, {REAL} AS realized, {sig('1.2e0', '0.1e0', 'hearing_score')} AS p FROM li
    WHERE heard IS NOT NULL AND {sig('1.2e0', '0.1e0', 'hearing_score')} >= {V.HTHR}),
  a AS (SELECT *, '' AS place, 0 AS tier FROM f WHERE heard <> realized ORDER BY utterance_id, token_index LIMIT 15),
  b AS (SELECT *, md5(concat_ws(':', '42', utterance_id, CAST(token_index AS VARCHAR))) AS place, 1 AS tier FROM f WHERE heard = realized
        ORDER BY place, utterance_id, token_index LIMIT 30),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT utterance_id, token_index, l1, heard, realized, round(p, 4) AS p_heard_realized, heard = realized AS correct_report
  FROM u ORDER BY tier, place, utterance_id, token_index LIMIT 30""")
def i3_hearing_sample(spark, sf):
    return S.hearing_sample(V.li_indexed(spark, sf), V.TARGET, V.HA, V.HB, V.HTHR)


@query(f"""WITH {V.LI_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY
    md5(concat_ws(':', '42:cap', audio_path)), audio_path) AS rk FROM li0 WHERE phone <> 'ð')
  SELECT audio_path, phone FROM r WHERE rk <= 700 UNION ALL SELECT audio_path, phone FROM li0 WHERE phone = 'ð'""")
def i4_cap_per_class(spark, sf):
    rows = V.li(spark, sf).select("audio_path", "phone")
    return S.cap_per_class(rows, 700, "phone", F.col("phone") == "ð", ["audio_path"])


@query(f"""WITH {V.LI_CTE} SELECT audio_path FROM li0
  ORDER BY md5(concat_ws(':', '42', audio_path)), audio_path LIMIT 500""")
def i5_cap_rows(spark, sf):
    return S.cap_rows(V.li(spark, sf).select("audio_path"), 500, ["audio_path"])


@query(f"""WITH {V.LI_INDEXED_CTE} SELECT utterance_id, token_index, phone, score FROM
  (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY token_index) AS rk FROM li) WHERE rk = 1
  ORDER BY utterance_id LIMIT 300""")
def i6_limit_utterances(spark, sf):
    return S.limit_utterances(
        V.li_indexed(spark, sf).select("utterance_id", "token_index", "phone", "score"), 300)


@query(f"""WITH {V.LI_CTE} SELECT audio_path, unnest(range(1, CASE WHEN l_partkey % 10 = 3 THEN 5 ELSE 2 END))::INT AS copy
  FROM li0""")
def i8_repeat_rows(spark, sf):
    return S.repeat_rows(
        V.li(spark, sf).select("audio_path", "l_partkey"), F.col("l_partkey") % 10 == 3, 4).select("audio_path", "copy")


@query(f"""WITH {V.LI_CTE}, r AS (SELECT phone, audio_path, row_number() OVER (PARTITION BY phone ORDER BY
    md5(concat_ws(':', '42:batches', audio_path)), audio_path) - 1 AS i, count(*) OVER (PARTITION BY phone) AS n FROM li0),
  k AS (SELECT (count(*) + 31) // 32 AS batches, greatest(1, 32 // count(DISTINCT phone)) AS share FROM li0),
  s AS (SELECT phone, unnest(range(batches * share)) AS slot, share FROM (SELECT DISTINCT phone FROM li0), k)
  SELECT slot // share + 1 AS batch, s.phone, slot % share + 1 AS slot, audio_path
  FROM s JOIN r ON r.phone = s.phone AND r.i = s.slot % r.n""")
def i9_balanced_batches(spark, sf):
    return S.balanced_batches(V.li(spark, sf).select("audio_path", "phone"), "phone", ["audio_path"], 32)


CLASS = """(CASE WHEN label = 'correct' THEN CASE WHEN phone IN ('ð', 'z', 'd') THEN phone
  WHEN phone IN ('θ', 's', 't', 'f', 'l', 'v') THEN 'other' END
  WHEN label = 'substituted' AND phone = 'ð' THEN CASE WHEN substituted_with IN ('ð', 'z', 'd') THEN substituted_with
  WHEN substituted_with <> '' THEN 'other' END END)"""
CLOSED = """(CASE WHEN label = 'correct' THEN CASE WHEN phone IN ('ð', 'z', 'd', 'v') THEN phone END
  WHEN label = 'substituted' AND phone = 'ð' THEN CASE WHEN substituted_with IN ('ð', 'z', 'd', 'v') THEN substituted_with END END)"""


@query(f"WITH {V.LI_CTE} SELECT audio_path, {CLASS} AS open_class, {CLOSED} AS closed_class FROM li0")
def b15_class_label(spark, sf):
    return V.li(spark, sf).select(
        "audio_path", S.class_label(K.OPEN_ALPHABET).alias("open_class"),
        S.class_label(K.CLOSED_ALPHABET).alias("closed_class"))


def exported(spark, sf):
    return S.export_rows(V.li_split(spark, sf), K.OPEN_ALPHABET, ["ð", "z", "d"])


EXPORT_CTE = f"""li AS (SELECT * FROM li0), {V.SPLIT_CTE}, ex AS (SELECT * EXCLUDE (split), {CLASS} AS class,
  CASE WHEN {V.bucket_sql("concat_ws(':', '42', 'val', utterance_id)")} < 15 THEN 'val' ELSE 'train' END AS split
  FROM lis WHERE split = 'train' AND phone IN ('ð', 'z', 'd', {", ".join(f"'{p}'" for p in K.OTHER_SOURCES)}))"""


@query(f"""WITH {V.LI_CTE}, {EXPORT_CTE} SELECT lis.split AS exam_split, count(DISTINCT ex.utterance_id) AS utterances
  FROM ex JOIN lis ON lis.utterance_id = ex.utterance_id AND lis.speaker = ex.speaker AND lis.corpus = 'open' GROUP BY 1""")
def j3_leakage_of_exports(spark, sf):
    """Exam splits of the open-corpus speakers of exported rows: train only."""
    exam = V.li_split(spark, sf).filter("corpus = 'open' AND speaker IS NOT NULL").select(
        "utterance_id", "speaker", F.col("split").alias("exam_split")).distinct()
    rows = exported(spark, sf).select("utterance_id", "speaker").distinct().join(exam, ["utterance_id", "speaker"])
    return rows.groupBy("exam_split").agg(F.countDistinct("utterance_id").alias("utterances"))


@query(f"""WITH {V.LI_CTE}, {EXPORT_CTE}, t AS (
  SELECT 'class' AS kind, class AS name FROM ex WHERE class IS NOT NULL
  UNION ALL SELECT 'split', split FROM ex WHERE class IS NOT NULL
  UNION ALL SELECT 'skipped', CASE WHEN label <> 'substituted' THEN label
    ELSE 'realized /' || coalesce(substituted_with, 'None') || '/' END FROM ex WHERE class IS NULL)
  SELECT kind, name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kind, name, count(*) AS n FROM t GROUP BY ALL
    UNION ALL SELECT 'class', unnest(['ð', 'z', 'd', 'other']), 0) GROUP BY ALL""")
def d26_export_counts(spark, sf):
    return S.export_counts(exported(spark, sf), K.OPEN_ALPHABET)


@query(f"""WITH {V.LI_CTE}, {EXPORT_CTE}, c AS (SELECT class, count(*) AS n FROM ex WHERE class IS NOT NULL GROUP BY class)
  SELECT class, n, round((SELECT sum(n) FROM c) / (4.0e0 * n) * CASE class WHEN 'ð' THEN 1.5e0 ELSE 1.0e0 END, 6) AS weight FROM c""")
def d27_class_weights(spark, sf):
    rows = exported(spark, sf).filter(F.col("class").isNotNull())
    return S.class_weights(rows, "class", K.OPEN_ALPHABET, 1.5)


@query(f"""WITH {V.LI_INDEXED_CTE}, s AS (SELECT utterance_id, token_index,
    CASE WHEN token_index = 0 THEN least(floor((start_s - 0.02e0) * 16000), floor((start_s - 0.1e0) * 16000))
      ELSE floor((start_s - 0.1e0) * 16000) END AS f,
    least(floor(42.5e0 * 16000), floor((end_s + 0.1e0) * 16000)) AS l FROM li)
  SELECT utterance_id, token_index, CAST(greatest(0, f) AS BIGINT) AS first_sample, CAST(l AS BIGINT) AS last_sample,
    CASE WHEN l - greatest(0, f) <= 0 THEN 'empty interval' WHEN l - greatest(0, f) < 480 THEN 'too short' END AS reject_reason
  FROM s""")
def g6_slice_bounds(spark, sf):
    rows = S.slice_bounds(
        V.li_indexed(spark, sf), 0.1, F.lit(42.5), F.col("start_s") - 0.02)
    return rows.select("utterance_id", "token_index", "first_sample", "last_sample", "reject_reason")


def with_verdicts(rows):
    """The columns a record needs beyond the view before it is written."""
    return rows.withColumns({"verdict": F.lit("uncertain"), "confidence": F.lit(0.0)})
