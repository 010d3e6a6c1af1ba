"""Queries over posteriors, vectors, signals and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe.bindings import views as V
from phonoframe.functions import scalar as S
from phonoframe.functions.spectral import spectral_features
from phonoframe.operators import contour as C
from phonoframe.operators import frames as G
from phonoframe.operators import metrics as M
from phonoframe.operators import posteriors as P
from phonoframe.operators import splits as SP
from phonoframe.operators.storage import scratch
from phonoframe.sources import shards as SH

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def scored(spark, sf):
    return V.post(spark, sf).withColumn("frames", P.log_softmax("logits"))


def args():
    return [F.col(c) for c in ("frames", "label_frames", "target", "confusions")]


LABEL = "t IN (1, 2, 3, 4, 5)"
CLOSED_CTE = V.POST_CTE + f""", closed AS (SELECT utt, klass, target, label, k, CASE WHEN k = 0 THEN target ELSE 1 + (klass % 7 + k) % 7 END AS token FROM post0, (SELECT unnest([0, 1, 2, 3]) AS k)),
  cm AS (SELECT c.utt, c.k, c.token, avg(exp(logp)) AS m FROM closed c JOIN logp l ON l.utt = c.utt AND l.token = c.token AND {LABEL} GROUP BY ALL),
  cp AS (SELECT *, m / (sum(m) OVER (PARTITION BY utt) + 1e-12) AS p FROM cm),
  cs AS (SELECT utt, max(p) FILTER (k = 0) AS own, max(p) FILTER (k > 0) AS rival, arg_max(token, p) FILTER (k > 0) AS best, arg_max(token, p) AS top FROM cp GROUP BY utt)"""


@query(f"WITH {V.POST_CTE} SELECT utt, t, token, round(logp, 6) AS logp FROM logp")
def e1_log_softmax(spark, sf):
    rows = P.explode_frames(scored(spark, sf), "frames", ["utt"])
    return rows.select("utt", "t", "token", F.round("logp", 6).alias("logp"))


@query("SELECT vec_id AS utt, 8 AS frames, CAST(8 AS BIGINT) AS kept, round((1 + vec_id % 5) / 10.0e0 / 8, 9) AS hop FROM embeddings")
def e1_pack_frames(spark, sf):
    """Long rows packed again; ``kept`` counts the frames that are as they were."""
    rows = scored(spark, sf)
    packed = P.pack_frames(P.explode_frames(rows, "frames", ["utt"]), "utt").withColumnRenamed("frames", "packed")
    duration = (1 + F.col("utt") % 5) / 10.0
    same = F.size(F.filter(F.arrays_zip("frames", "packed"), lambda f: f["frames"] == f["packed"]))
    return rows.join(packed, "utt").select(
        "utt", F.size("packed").alias("frames"), same.cast("bigint").alias("kept"),
        F.round(P.hop_seconds("packed", duration), 9).alias("hop"))


@query(f"WITH {CLOSED_CTE} SELECT utt, round(ln((rival + 1e-12) / (own + 1e-12)), 6) AS score, best, round(own, 6) AS p_target FROM cs")
def e2_contrast_mean(spark, sf):
    rows = scored(spark, sf).withColumn("c", P.contrast_mean(*args()))
    return rows.select("utt", F.round("c.score", 6).alias("score"), "c.best",
                       F.round(F.get("c.posteriors", F.lit(0)), 6).alias("p_target"))


FRAME_CTE = CLOSED_CTE + f""", fm AS (SELECT l.utt, t, max(logp) AS mx FROM closed c JOIN logp l ON l.utt = c.utt AND l.token = c.token AND {LABEL} GROUP BY l.utt, t),
  fp AS (SELECT l.utt, l.t, sum(exp(logp - mx)) AS z, max(exp(logp - mx)) FILTER (k > 0) AS rv, max(exp(logp - mx)) FILTER (k = 0) AS ow FROM closed c JOIN logp l ON l.utt = c.utt AND l.token = c.token
     JOIN fm ON fm.utt = l.utt AND fm.t = l.t GROUP BY l.utt, l.t)"""


@query(f"WITH {FRAME_CTE} SELECT utt, round(max(ln((rv / z + 1e-12) / (ow / z + 1e-12))), 6) AS spike FROM fp GROUP BY utt")
def e3_contrast_spike(spark, sf):
    return scored(spark, sf).select("utt", F.round(P.contrast_spike(*args()), 6).alias("spike"))


@query(f"WITH {FRAME_CTE} SELECT utt, round(avg(CASE WHEN rv / z > ow / z THEN 1.0e0 ELSE 0.0e0 END), 6) AS vote FROM fp GROUP BY utt")
def e4_contrast_vote(spark, sf):
    return scored(spark, sf).select("utt", F.round(P.contrast_vote(*args()), 6).alias("vote"))


TABLE = [1, 2, 3, 4, 5, 6]
HEARD_CTE = CLOSED_CTE + f""", fu AS (SELECT utt, token, CASE WHEN token = 0 THEN 0.0e0 ELSE avg(exp(logp)) END AS m FROM logp WHERE {LABEL} GROUP BY utt, token),
  hw AS (SELECT utt, arg_max(token, m) AS w, max(m) / (sum(m) + 1e-12) AS p FROM fu GROUP BY utt),
  hd AS (SELECT hw.utt, CASE WHEN w <> 7 THEN w ELSE top END AS heard, CASE WHEN w <> 7 THEN p ELSE greatest(own, rival) END AS p FROM hw JOIN cs ON cs.utt = hw.utt),
  ph AS (SELECT hd.utt, label, l1, klass, target, substituted_with, heard, ln((p + 1e-12) / (1 - p + 1e-12)) AS hearing_score FROM hd JOIN post0 ON post0.utt = hd.utt)"""


@query(f"WITH {HEARD_CTE} SELECT utt, heard, round(hearing_score, 6) AS hearing_score FROM ph")
def e5_heard(spark, sf):
    table = F.array(*[F.lit(k) for k in TABLE])
    rows = scored(spark, sf).withColumn("h", P.heard(*args(), 0, table))
    return rows.select("utt", F.col("h.token").alias("heard"), F.round("h.hearing_score", 6).alias("hearing_score"))


def mirror_rows(spark, sf):
    """Posterior utterances as mirror records; phones are token numbers as text."""
    table = F.array(*[F.lit(k) for k in TABLE])
    rows = scored(spark, sf).withColumn("h", P.heard(*args(), 0, table))
    return rows.select(
        "utt", "l1", "label", F.col("target").cast("string").alias("target"),
        F.col("substituted_with").cast("string").alias("substituted_with"),
        F.col("h.token").cast("string").alias("heard"), F.col("h.hearing_score").alias("hearing_score"))


@query(f"""WITH {HEARD_CTE}, r AS (SELECT *, CASE label WHEN 'correct' THEN CAST(target AS VARCHAR) WHEN 'deleted' THEN '∅' ELSE CAST(substituted_with AS VARCHAR) END AS real,
    1.0e0 / (1.0e0 + exp(-(1.1e0 * hearing_score - 0.2e0))) >= 0.6e0 AS sure, CAST(heard AS VARCHAR) AS hv FROM ph)
  SELECT l1, count(*) AS tokens, count(hv) AS scored, count(*) FILTER (sure) AS confident, count(*) FILTER (sure AND hv = real) AS correct,
   round(count(*) FILTER (sure AND hv = real) * 1.0e0 / count(*) FILTER (sure AND real IS NOT NULL), 4) AS accuracy, round(count(*) FILTER (sure) * 1.0e0 / count(*), 4) AS coverage,
   round(count(*) FILTER (sure) * 1.0e0 / count(hv), 4) AS answer_rate, count(*) FILTER (sure) - count(*) FILTER (sure AND real IS NOT NULL) AS unscorable,
   round(count(*) FILTER (hv = real) * 1.0e0 / count(real), 4) AS top1_accuracy FROM r GROUP BY l1""")
def d7_hearing_metrics_posteriors(spark, sf):
    return M.hearing_metrics(mirror_rows(spark, sf), F.col("target"), 1.1, -0.2, 0.6, ["l1"])


@query(f"""WITH {V.POST_CTE}, b AS (SELECT utt, t, max(logp) AS best, max(logp) FILTER (token = target) AS own FROM logp WHERE {LABEL} GROUP BY utt, t)
  SELECT utt, round(avg(own - best), 6) AS gop, round(exp(avg(best)), 6) AS confidence FROM b GROUP BY utt""")
def e6_gop(spark, sf):
    rows = scored(spark, sf).withColumn("g", P.gop(F.col("frames"), F.col("label_frames"), F.col("target")))
    return rows.select("utt", F.round("g.gop", 6).alias("gop"), F.round("g.confidence", 6).alias("confidence"))


def targets():
    return F.array(F.col("target"), (1 + F.col("target") % 7).cast("int"), F.col("target"))


@query(f"""WITH {V.POST_CTE}, {V.path_cte(["target", "1 + target % 7", "target"])}
  SELECT utt, string_agg(s, ' ' ORDER BY t) AS path, CAST(NULL AS VARCHAR) AS reason FROM path GROUP BY utt""")
def e7_forced_align(spark, sf):
    rows = scored(spark, sf).withColumn("targets", targets())
    path = F.when(P.align_problem(F.col("frames"), F.col("targets")).isNull(),
                  P.forced_align(F.col("frames"), F.col("targets")))
    return rows.select("utt", F.array_join(path, " ").alias("path"),
                       P.align_problem(F.col("frames"), F.col("targets")).alias("reason"))


PATH_CTE = """pt AS (SELECT vec_id AS utt, t, CAST(sum(CASE WHEN CAST(embedding[t + 1] AS DOUBLE) > 0.05e0 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS INT) AS s
   FROM embeddings, (SELECT unnest(range(64)) AS t))"""


@query(f"""WITH {PATH_CTE}, lb AS (SELECT utt, (s - 1) // 2 AS idx, min(t) AS a, max(t) AS b, count(*) AS n FROM pt WHERE s % 2 = 1 GROUP BY ALL),
  sg AS (SELECT *, lag(b) OVER (PARTITION BY utt ORDER BY idx) AS pb, lead(a) OVER (PARTITION BY utt ORDER BY idx) AS na FROM lb)
  SELECT utt, idx, CASE WHEN pb IS NULL THEN a ELSE (pb + a) // 2 + 1 END AS start_frame, CASE WHEN na IS NULL THEN b + 1 ELSE (b + na) // 2 + 1 END AS end_frame, n AS label_frames FROM sg""")
def e8_phone_segments(spark, sf):
    rows = V.table(spark, sf, "embeddings").withColumn("on", F.transform(
        "embedding", lambda x: F.when(x.cast("double") > 0.05, 1).otherwise(0)))
    steps = F.aggregate("on", F.array().cast("array<int>"), lambda acc, x: F.concat(
        acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    paths = rows.withColumn("path", steps).withColumn("n", F.expr("(element_at(path, -1) + 1) div 2").cast("int"))
    segs = paths.filter("n > 0").select(
        F.col("vec_id").alias("utt"), F.explode(P.phone_segments(F.col("path"), F.col("n"))).alias("s"))
    return segs.select("utt", F.col("s.index").alias("idx"), "s.start_frame", "s.end_frame",
                       F.size("s.frames").cast("bigint").alias("label_frames"))


TOKENS = "floor(10 * abs(CAST(embedding[k + 1] AS DOUBLE)))"
GREEDY_CTE = f"""tk AS (SELECT vec_id, k, CAST({TOKENS} AS BIGINT) AS x FROM embeddings, (SELECT unnest(range(64)) AS k)),
  gd AS (SELECT vec_id, k, x, lag(x) OVER (PARTITION BY vec_id ORDER BY k) AS px FROM tk),
  gs AS (SELECT vec_id, string_agg(CAST(x AS VARCHAR), ' ' ORDER BY k) FILTER (x <> 0 AND (px IS NULL OR x <> px)) AS decoded FROM gd GROUP BY vec_id)"""


def decoded(spark, sf):
    ids = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 10.0))
    return V.table(spark, sf, "embeddings").withColumn("ids", ids).withColumn("decoded", P.ctc_greedy("ids"))


@query(f"WITH {GREEDY_CTE} SELECT vec_id, coalesce(decoded, '') AS decoded FROM gs")
def e9_ctc_greedy(spark, sf):
    return decoded(spark, sf).select("vec_id", F.array_join("decoded", " ").alias("decoded"))


@query(f"""WITH {GREEDY_CTE}, x AS (SELECT vec_id, coalesce(decoded, '') AS d FROM gs)
  SELECT count(*) AS clips, count(*) FILTER (CASE WHEN vec_id % 4 = 0 THEN false ELSE true END) AS exact,
  round(count(*) FILTER (CASE WHEN vec_id % 4 = 0 THEN false ELSE true END) * 1.0e0 / count(*), 4) AS accuracy FROM x""")
def d30_sequence_accuracy(spark, sf):
    rows = decoded(spark, sf)
    target = F.when(F.col("vec_id") % 4 == 0, F.concat("decoded", F.array(F.lit(1).cast("bigint")))).otherwise(F.col("decoded"))
    return M.sequence_accuracy(rows, F.col("decoded"), target)


CLASS_MASS = f"""{V.POST_CTE}, cl AS (SELECT utt, t, token, CASE WHEN token IN (1, 2, 3) THEN 'c' || token ELSE 'other' END AS name, logp FROM logp WHERE {LABEL} AND token <> 0),
  pm AS (SELECT utt, t, name, max(logp) AS m FROM cl GROUP BY ALL), pf AS (SELECT *, exp(m - max(m) OVER (PARTITION BY utt, t)) AS e FROM pm),
  pa AS (SELECT utt, name, avg(e) AS a FROM pf GROUP BY ALL), ps AS (SELECT *, a / (sum(a) OVER (PARTITION BY utt) + 1e-12) AS share FROM pa)"""


@query(f"WITH {CLASS_MASS} SELECT utt, CASE WHEN max(share) >= 0.6e0 THEN arg_max(name, share) END AS realized FROM ps GROUP BY utt")
def e10_realized_class(spark, sf):
    tokens = lambda ks: F.array(*[F.lit(k) for k in ks])
    classes = F.array(*[F.struct(F.lit(n).alias("name"), tokens(k).alias("tokens"))
                        for n, k in (("c1", [1]), ("c2", [2]), ("c3", [3]), ("other", [4, 5, 6, 7]))])
    return scored(spark, sf).select(
        "utt", P.realized_class(F.col("frames"), F.col("label_frames"), classes).alias("realized"))


# -- vectors -----------------------------------------------------------------------------


@query("""WITH x AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS k)),
  s AS (SELECT vec_id, avg(x) AS mu, var_pop(x) AS v FROM x GROUP BY vec_id)
  SELECT x.vec_id, k, round((x - mu) / sqrt(v + 1e-7), 6) AS z FROM x JOIN s ON s.vec_id = x.vec_id""")
def b18_zscore(spark, sf):
    rows = V.table(spark, sf, "embeddings").select("vec_id", F.posexplode(S.zscore("embedding")).alias("k", "z"))
    return rows.select("vec_id", "k", F.round("z", 6).alias("z"))


@query("""WITH p AS (SELECT label AS e, (list_position(embedding, list_max(embedding)) - 1) % 10 AS p FROM embeddings), c AS (SELECT unnest(range(10)) AS class),
  k AS (SELECT class, count(*) FILTER (e = class AND p = class) AS tp, count(*) FILTER (e = class) AS n, count(*) FILTER (p = class) AS q FROM p, c GROUP BY class)
  SELECT CAST(class AS INT) AS class, n, CASE WHEN n > 0 THEN round(tp * 1.0e0 / n, 4) END AS class_accuracy, (SELECT round(count(*) FILTER (e = p) * 1.0e0 / count(*), 4) FROM p) AS accuracy,
   (SELECT round(avg(CASE WHEN n + q > 0 THEN 2.0e0 * tp / (n + q) ELSE 0 END), 4) FROM k) AS macro_f1 FROM k""")
def d28_multiclass_metrics(spark, sf):
    rows = V.table(spark, sf, "embeddings").select(
        F.col("label").alias("expected"), (S.first_argmax(F.col("embedding")) % 10).cast("int").alias("predicted"))
    return M.multiclass_metrics(rows, list(range(10)), "expected", "predicted")


def contour_pairs(spark, sf):
    vecs = V.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10.0).alias("a"))
    nexts = vecs.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return vecs.join(nexts, "vec_id")


# a diagonal of the cost table per turn, as lists over the rows 0 .. 64
DTW_CTE = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10.0e0) AS a FROM embeddings),
  p AS MATERIALIZED (SELECT x.vec_id, x.a, y.a AS b FROM v x JOIN v y ON y.vec_id = x.vec_id + 1),
  w AS (SELECT vec_id, a, b, 2 AS d, list_transform(range(0, 65), lambda i: CASE WHEN i = 0 THEN 0.0e0 ELSE CAST('inf' AS DOUBLE) END) AS older,
      list_transform(range(0, 65), lambda i: CAST('inf' AS DOUBLE)) AS newer FROM p
    UNION ALL SELECT vec_id, a, b, d + 1, newer, list_transform(range(0, 65), lambda i: CASE WHEN i >= greatest(1, d - 64) AND i <= least(64, d - 1)
      THEN (a[i] - b[d - i]) * (a[i] - b[d - i]) + least(newer[i], newer[i + 1], older[i]) ELSE CAST('inf' AS DOUBLE) END) FROM w WHERE d <= 128),
  dtw AS (SELECT vec_id, newer[65] / 128 AS distance FROM w WHERE d = 129)"""


@query(f"WITH RECURSIVE {DTW_CTE} SELECT vec_id, round(distance, 6) AS distance FROM dtw")
def f9_dtw(spark, sf):
    rows = contour_pairs(spark, sf)
    return rows.select("vec_id", F.round(C.dtw_distance("a", "b"), 6).alias("distance"))


@query(f"WITH RECURSIVE {DTW_CTE} SELECT vec_id, round(exp(-sqrt(distance) / 4.0e0), 6) AS match FROM dtw")
def f10_contour_match(spark, sf):
    rows = contour_pairs(spark, sf).withColumn("d", C.dtw_distance("a", "b"))
    return rows.select("vec_id", F.round(C.contour_match("d"), 6).alias("match"))


# -- signals -----------------------------------------------------------------------------


@query(f"""WITH {V.SIG_CTE}, n AS (SELECT sig, count(*) AS n FROM sig GROUP BY sig), f AS (SELECT sig, unnest(range((n - 400) // 160 + 1)) AS k FROM n WHERE n >= 400)
  SELECT f.sig, k, round(20 * log10(greatest(sqrt(avg(x * x)), 1e-10)), 4) AS db FROM f JOIN sig ON sig.sig = f.sig AND pos >= k * 160 AND pos < k * 160 + 400 GROUP BY f.sig, k""")
def g1_frame_rms(spark, sf):
    rows = V.sig(spark, sf).select("sig", F.posexplode(G.frame_rms_db("samples")).alias("k", "db"))
    return rows.select("sig", "k", F.round("db", 4).alias("db"))


@query(f"""WITH {V.SIG_CTE}, n AS (SELECT sig, count(*) AS n FROM sig GROUP BY sig), e AS (SELECT sig, pos // 320 AS k, sqrt(avg(x * x)) AS e, count(*) AS c FROM sig GROUP BY ALL)
  SELECT sig, k, round(e, 6) AS energy FROM e WHERE c = 320""")
def g1_energy_profile(spark, sf):
    rows = V.sig(spark, sf).select("sig", F.posexplode(G.energy_profile("samples")).alias("k", "energy"))
    return rows.select("sig", "k", F.round("energy", 6).alias("energy"))


@query(f"""WITH {V.SIG_CTE}, q AS (SELECT sig, count(*) AS n, count(*) FILTER (abs(x * 1.2e0) >= 0.995e0) AS c, coalesce(sqrt(avg(x * x * 1.44e0) FILTER (pos >= 500 AND pos < 1500)), sqrt(avg(x * x * 1.44e0))) AS r, max(abs(x * 1.2e0)) AS p FROM sig GROUP BY sig)
  SELECT sig, c > greatest(1, floor(0.001e0 * n)) AS clipping, 20 * log10(greatest(r, 1e-10)) < -70 AS too_quiet, round(20 * log10(greatest(r, 1e-10)), 1) AS speech_level_dbfs,
    round(20 * log10(greatest(r, 1e-10)), 1) < -40 AS low_level, round(20 * log10(greatest(p, 1e-10)), 1) AS peak_dbfs FROM q""")
def g3_quality(spark, sf):
    rows = V.sig(spark, sf).withColumn("samples", F.transform("samples", lambda x: x * 1.2))
    return rows.withColumn("q", G.quality("samples", F.slice("samples", 501, 1000))).select("sig", "q.*")


@query(f"""WITH {V.SIG_CTE}, n AS (SELECT sig, count(*) AS n, avg(x) AS mu, sqrt(avg(x * x) + 1e-9) AS rms FROM sig GROUP BY sig),
  z AS (SELECT a.sig, avg(CASE WHEN (a.x < 0) <> (b.x < 0) THEN 1.0e0 ELSE 0.0e0 END) AS zc FROM sig a JOIN sig b ON a.sig = b.sig AND b.pos = a.pos + 1 GROUP BY a.sig),
  f AS (SELECT n.sig, k, sqrt(avg(x * x) + 1e-9) AS r FROM n, (SELECT unnest(range(30)) AS k), sig WHERE sig.sig = n.sig AND k <= (n - 160) // 80 AND n >= 160 AND pos >= k * 80 AND pos < k * 80 + 160 GROUP BY n.sig, k),
  d AS (SELECT *, r - lag(r) OVER (PARTITION BY sig ORDER BY k) AS rise FROM f),
  e AS (SELECT sig, min(r) AS lo, max(r) AS hi, avg(r) + 1e-9 AS mid, max(rise) AS up FROM d GROUP BY sig),
  c AS (SELECT sig.sig, pos, x - mu AS y FROM sig JOIN n ON n.sig = sig.sig),
  ac AS (SELECT a.sig, lag_k, sum(a.y * b.y) AS s FROM c a, (SELECT unnest(range(40, 228)) AS lag_k), c b WHERE b.sig = a.sig AND b.pos = a.pos + lag_k GROUP BY ALL),
  v AS (SELECT ac.sig, max(s) AS s FROM ac GROUP BY ac.sig), b AS (SELECT sig, sum(y * y) + 1e-9 AS s0 FROM c GROUP BY sig)
  SELECT n.sig, round(least(greatest(20 * log10(rms + 1e-9), -80), 0) / 80.0e0 + 1, 6) AS rms_db, round(least(greatest(zc * 16 / 16.0e0, 0), 1), 6) AS zero_crossing,
   coalesce(round(least(greatest(log10((lo + 1e-9) / (mid + 1e-9)), -3), 0) / -3.0e0, 6), 0) AS closure_dip, coalesce(round(least(greatest(up / (mid + 1e-9) / 3.0e0, 0), 1), 6), 0) AS burst_sharpness,
   coalesce(round(least(greatest(log10((hi + 1e-9) / (lo + 1e-9)), 0), 3) / 3.0e0, 6), 0) AS burst_contrast, CASE WHEN n > 228 THEN round(least(greatest(v.s / s0, 0), 1), 6) ELSE 0.5e0 END AS voicing
  FROM n JOIN z ON z.sig = n.sig LEFT JOIN e ON e.sig = n.sig LEFT JOIN v ON v.sig = n.sig JOIN b ON b.sig = n.sig""")
def g4_time_features(spark, sf):
    rows = V.sig(spark, sf).withColumn("f", G.time_features("samples")).select("sig", "f.*")
    return rows.select("sig", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


@query(f"""WITH {V.SIG_CTE}, n AS (SELECT sig, count(*) AS n FROM sig GROUP BY sig),
  y AS MATERIALIZED (SELECT sig.sig, pos, n, x * (0.5e0 - 0.5e0 * cos(2 * pi() * pos / (n - 1))) AS y FROM sig JOIN n ON n.sig = sig.sig),
  pw AS MATERIALIZED (SELECT y.sig, k, any_value(n) AS n, k * 16000.0e0 / any_value(n) AS hz,
    pow(sum(y * cos(2 * pi() * ((k * pos) % n) / n)), 2) + pow(sum(y * sin(2 * pi() * ((k * pos) % n) / n)), 2) + 1e-9 AS p
    FROM y, (SELECT unnest(range(1025)) AS k) WHERE k <= n // 2 GROUP BY y.sig, k),
  ag AS (SELECT sig, sum(p) AS whole, log10((sum(p) FILTER (hz BETWEEN 5000 AND 8000) + 1e-9) / (sum(p) FILTER (hz BETWEEN 1000 AND 3500) + 1e-9)) AS c,
    sum(hz * p) / sum(p) / 8000 AS centroid, exp(avg(ln(p))) / avg(p) AS flat FROM pw GROUP BY sig),
  cu AS (SELECT sig, hz, sum(p) OVER (PARTITION BY sig ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM pw),
  ro AS (SELECT cu.sig, min(hz) AS hz FROM cu JOIN ag ON ag.sig = cu.sig WHERE upto >= 0.85e0 * whole GROUP BY cu.sig)
  SELECT ag.sig, round(greatest(-2.5, least(1.5, c)) / 4.0e0 + 0.625e0, 6) AS sibilance, round(greatest(0, least(1, centroid)), 6) AS centroid,
    round(greatest(0, least(1, ro.hz / 8000)), 6) AS rolloff, round(greatest(0, least(1, flat)), 6) AS flatness FROM ag JOIN ro ON ro.sig = ag.sig""")
def g5_spectral_features(spark, sf):
    rows = V.sig(spark, sf).withColumn("f", spectral_features("samples", "rate")).select("sig", "f.*")
    return rows.select("sig", *[F.round(c, 6).alias(c) for c in rows.columns[1:]])


def drawn_sql(draw: str, key: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws(':', '42', '{draw}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT) % 2147483648 + 0.5e0) / 2147483648.0e0)"


@query(f"""WITH {V.SIG_CTE}, n AS (SELECT sig, count(*) AS n FROM sig GROUP BY sig),
  d AS (SELECT sig, n, sig % 5 <> 0 AND {drawn_sql('use?', 'sig')} < 0.5e0 AS used, CASE WHEN {drawn_sql('stretch?', 'sig')} < 0.6e0 THEN 0.9e0 + 0.2e0 * {drawn_sql('factor', 'sig')} ELSE 1.0e0 END AS factor,
    CASE WHEN {drawn_sql('noise?', 'sig')} < 0.6e0 THEN 15.0e0 + 15.0e0 * {drawn_sql('snr', 'sig')} END AS snr FROM n),
  pl AS (SELECT d.*, pos, CAST(floor(n / factor) AS BIGINT) AS m, pos * (n - 1) * 1.0e0 / greatest(CAST(floor(n / factor) AS BIGINT) - 1, 1) AS place FROM d JOIN sig ON sig.sig = d.sig),
  mv AS (SELECT pl.sig, pl.pos, pl.n, used, snr, CASE WHEN NOT used OR factor = 1 THEN s.x WHEN pl.pos >= m THEN 0.0e0
      ELSE a.x + (coalesce(b.x, a.x) - a.x) * (place - floor(place)) END AS x FROM pl JOIN sig s ON s.sig = pl.sig AND s.pos = pl.pos
    LEFT JOIN sig a ON a.sig = pl.sig AND a.pos = CAST(floor(place) AS BIGINT) LEFT JOIN sig b ON b.sig = pl.sig AND b.pos = CAST(floor(place) AS BIGINT) + 1),
  sp AS (SELECT sig, sqrt(avg(x * x) + 1e-9) AS r FROM mv GROUP BY sig),
  ou AS (SELECT mv.sig, mv.n, CASE WHEN used AND snr IS NOT NULL THEN x + r / pow(10.0e0, snr / 20.0e0) * sqrt(-2.0e0 * ln({drawn_sql('radius', "mv.sig || '/' || pos")}))
      * cos(6.283185307179586e0 * {drawn_sql('angle', "mv.sig || '/' || pos")}) ELSE x END AS x FROM mv JOIN sp ON sp.sig = mv.sig)
  SELECT sig, CAST(any_value(n) AS INT) AS n_in, CAST(count(*) AS INT) AS n_out, round(avg(x * x), 6) AS power FROM ou GROUP BY sig""")
def g7_augment(spark, sf):
    rows = V.sig(spark, sf).withColumn("out", G.augment("samples", "sig", F.col("sig") % 5 == 0))
    return rows.select("sig", F.size("samples").alias("n_in"), F.size("out").alias("n_out"),
                       F.round(S.mean(F.transform("out", lambda x: x * x)), 6).alias("power"))


# -- clips -------------------------------------------------------------------------------

CLIP_CTE = "clip AS (SELECT doc_id AS id, source AS client_id, n_chars / 100.0e0 AS duration, text, n_chars FROM documents)"


def clips(spark, sf):
    return V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("client_id"),
        (F.col("n_chars") / 100.0).alias("duration"), "text", "n_chars")


@query(f"WITH {CLIP_CTE} SELECT id, CASE WHEN {V.bucket_sql('client_id')} < 5 THEN 'val' ELSE 'train' END AS split FROM clip")
def i13_client_split(spark, sf):
    return clips(spark, sf).select("id", S.client_split("client_id").alias("split"))


@query(f"WITH {CLIP_CTE} SELECT id, n_chars % 500 > 0 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) < n_chars % 500 AS trainable FROM clip")
def i14_ctc_valid(spark, sf):
    return clips(spark, sf).select("id", SP.ctc_valid(F.col("n_chars") % 500, "text").alias("trainable"))


@query(f"""WITH {CLIP_CTE}, u AS (SELECT *, sum(n_chars) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS s FROM clip WHERE duration >= 1 AND duration <= 30)
  SELECT id, duration FROM u WHERE s - n_chars < 150000""")
def i7_budget_select(spark, sf):
    rows = SP.budget_select(
        clips(spark, sf), "id", "n_chars", 150000, None, F.expr("id div 16"), 100, 3000)
    return rows.select("id", "duration")


@query(f"""WITH {CLIP_CTE}, u AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM clip WHERE duration >= 1 AND duration <= 30) SELECT id, duration FROM u WHERE r <= 77""")
def i7_budget_clip_cap(spark, sf):
    rows = SP.budget_select(clips(spark, sf), "id", "duration", 1e9, 77, F.expr("id div 16"))
    return rows.select("id", "duration")


@query(f"""WITH {CLIP_CTE}, s AS (SELECT id, n_chars AS length, (row_number() OVER (ORDER BY id) - 1) // 50 AS shard FROM clip)
  SELECT id, shard, length, CAST(coalesce(sum(length) OVER (PARTITION BY shard ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s""")
def a13_shards(spark, sf):
    rows = SP.shards(clips(spark, sf), ["id"], F.col("n_chars"), 50, F.expr("id div 16"))
    return rows.select("id", "shard", "length", "start")


def torn(path: str, entry: dict) -> None:
    """Take the frames of a shard away."""
    fs, root = SH._place(path)
    fs.delete_file(f"{root}/{entry['name']}.npy")


@query(f"""WITH {CLIP_CTE}, s AS (SELECT id, client_id, 1 + n_chars % 20 AS length, (row_number() OVER (ORDER BY id) - 1) // 50 AS shard FROM clip),
  o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    list_sum(list_transform(range(length * 4), lambda k: (id * 31 + k) % 256)) AS total FROM s WHERE shard <> 1)
  SELECT shard, count(*) AS clips, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(total) AS DOUBLE) AS total,
    count(*) FILTER ({V.bucket_sql('client_id')} < 5) AS val FROM o GROUP BY shard""")
def a13_shard_store(spark, sf):
    """Shards written, the second one torn, and read again."""
    rows = SP.shards(clips(spark, sf), ["id"], 1 + F.col("n_chars") % 20, 50, F.expr("id div 16")).withColumns({
        "tokens": F.col("text"), "split": S.client_split("client_id"),
        "features": F.expr("transform(sequence(0L, length * 4 - 1), k -> CAST((id * 31 + k) % 256 AS FLOAT))")})
    SH.write_shards(rows, path := scratch(spark, "shards"), 4)
    torn(path, next(e for e in SH.manifest(path)["shards"] if e["shard"] == 1))
    back = SH.read_shards(spark, path)
    total = F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x)
    return back.groupBy("shard").agg(
        F.count("*").alias("clips"), F.sum("start").alias("starts"), F.sum(total).alias("total"),
        S.count_if(F.col("split") == "val").alias("val"))


@query(f"""WITH {CLIP_CTE}, f AS (SELECT *, duration BETWEEN 1 AND 30 AS usable, client_id <> 'src3' AS known FROM clip)
  SELECT round(sum(CASE WHEN usable AND known THEN duration ELSE 0 END) / 3600, 2) AS hours, count(*) FILTER (usable AND known) AS clips, count(*) FILTER (usable AND NOT known) AS skipped, count(*) AS seen FROM f""")
def d31_prep_summary(spark, sf):
    return SP.prep_summary(clips(spark, sf), "duration", F.col("duration").between(1, 30), F.col("client_id") != "src3")
