"""Queries over intervals, annotators and pitch contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.bindings import views as V
from phonoframe.operators import contour as C
from phonoframe.operators import intervals as I
from phonoframe.operators import splits as S
from phonoframe.operators import tones as T

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def r4(*names):
    return [F.round(n, 4).alias(n) for n in names]


# -- interval joins ---------------------------------------------------------------------

ANN_ID = ["passage", "unit_id", "l_linenumber", "l_suppkey"]
AG = f"{V.GRID_CTE}, {V.ANN_CTE}"


def ann_intervals(spark, sf):
    return V.ann(spark, sf).select(
        F.concat(F.lit("p"), F.col("passage").cast("string")).alias("path"), *ANN_ID[1:],
        F.col("start_s").alias("xmin"), F.col("end_s").alias("xmax"))


@query(f"""WITH {AG} SELECT path, g.idx, unit_id AS r_unit_id, round(greatest(0.0e0, least(xmax, end_s) - greatest(xmin, start_s))
    / greatest(1e-9, xmax - xmin), 6) AS overlap FROM grid g JOIN ann ON path = 'p' || passage AND end_s > xmin AND start_s < xmax""")
def c4_overlap_join(spark, sf):
    words = V.grid(spark, sf).select("path", "idx", "xmin", "xmax")
    pairs = I.overlap_join(words, ann_intervals(spark, sf), "path", width=2.0)
    return pairs.select("path", "idx", "r_unit_id", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {AG}, j AS (SELECT a.passage, a.unit_id, a.l_linenumber, a.l_suppkey, a.start_s, g.idx, g.xmin, g.xmax, row_number() OVER (PARTITION BY passage, unit_id, a.l_linenumber, a.l_suppkey
     ORDER BY g.idx) AS rn FROM ann a LEFT JOIN grid g ON path = 'p' || passage AND xmin - 0.01e0 <= start_s AND start_s <= xmax + 0.01e0)
  SELECT passage, unit_id, l_linenumber, l_suppkey, start_s AS t, idx, xmin AS unit_start, xmax AS unit_end FROM j WHERE rn = 1""")
def c5_point_in_interval(spark, sf):
    points = V.ann(spark, sf).select(*ANN_ID, F.col("start_s").alias("t"))
    units = V.grid(spark, sf).select(
        F.expr("CAST(substring(path, 2) AS BIGINT)").alias("passage"), "idx", "xmin", "xmax")
    return I.point_in_interval(points, units, "passage", ANN_ID, width=2.0)


def annotators(spark, sf):
    rows = V.ann(spark, sf).withColumn("ord", F.expr("l_linenumber * 1000000000L + unit_id * 1000 + l_suppkey"))
    return rows.filter("annotator = 'B'"), rows.filter("annotator = 'G'")


MATCH_CTE = f"""{V.ANN_CTE}, ao AS (SELECT *, CAST(l_linenumber AS BIGINT) * 1000000000 + unit_id * 1000 + l_suppkey AS ord FROM ann),
  m AS (SELECT a.passage, a.unit_id, a.l_linenumber, a.l_suppkey, a.expected_tone, a.text, b.expected_tone AS b_expected_tone, b.text AS b_text,
    row_number() OVER (PARTITION BY a.passage, a.unit_id, a.l_linenumber, a.l_suppkey ORDER BY b.ord) AS rn
    FROM (SELECT * FROM ao WHERE annotator = 'B') a LEFT JOIN (SELECT * FROM ao WHERE annotator = 'G') b
    ON a.passage = b.passage AND abs(b.start_s - a.start_s) < {{tol}} {{edge}}),
  pairs AS (SELECT * FROM m WHERE rn = 1)"""


def matched(spark, sf, tol=0.3, both=False):
    a, b = annotators(spark, sf)
    return I.tolerance_match(a, b, "passage", ANN_ID, ["expected_tone", "text"], "ord", tol, both)


@query(f"WITH {MATCH_CTE.format(tol=0.3, edge='')} SELECT passage, unit_id, l_linenumber, l_suppkey, expected_tone, b_expected_tone FROM pairs")
def c6_tolerance_match(spark, sf):
    return matched(spark, sf).select(*ANN_ID, "expected_tone", "b_expected_tone")


@query(f"WITH {MATCH_CTE.format(tol=0.2, edge='AND abs(b.end_s - a.end_s) < 0.2')} SELECT passage, unit_id, l_linenumber, l_suppkey, expected_tone, b_expected_tone FROM pairs")
def c6_edge_match(spark, sf):
    return matched(spark, sf, 0.2, True).select(*ANN_ID, "expected_tone", "b_expected_tone")


@query(f"""WITH {MATCH_CTE.format(tol=0.3, edge='')}, k AS (SELECT *, expected_tone = b_expected_tone AS ok FROM pairs WHERE b_expected_tone IS NOT NULL),
  t AS (SELECT 'class ' || expected_tone AS kind, ok FROM k UNION ALL SELECT 'overall', ok FROM k
    UNION ALL SELECT 'fall vs rise', ok FROM k WHERE expected_tone IN ('fall', 'rise') AND b_expected_tone IN ('fall', 'rise')
    UNION ALL SELECT 'fall reproduced', ok FROM k WHERE expected_tone = 'fall')
  SELECT kind, count(*) FILTER (ok) AS agree, count(*) AS total, round(count(*) FILTER (ok) * 1.0e0 / count(*), 4) AS share FROM t GROUP BY kind""")
def d17_agreement(spark, sf):
    return T.agreement(matched(spark, sf))


@query(f"""WITH {MATCH_CTE.format(tol=0.35, edge='')}, k AS (SELECT regexp_replace(text, '[^<>/~*_`^\\\\]', '', 'g') AS mark,
    regexp_replace(b_text, '[^<>/~*_`^\\\\]', '', 'g') AS other FROM pairs WHERE b_text IS NOT NULL),
  n AS (SELECT mark, other, count(*) AS n FROM k WHERE mark <> '' AND other <> '' GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mark ORDER BY n DESC, other) AS rank FROM n) WHERE rank <= 6""")
def d18_symbol_confusion(spark, sf):
    rows = matched(spark, sf, 0.35).select(T.marks_of("text").alias("mark"), T.marks_of("b_text").alias("other"))
    return T.symbol_confusion(rows, "mark", "other")


@query(f"""WITH {V.ANN_CTE} SELECT passage FROM ann WHERE annotator = 'B' INTERSECT SELECT passage FROM ann WHERE annotator = 'G'""")
def j2_both_annotated(spark, sf):
    a, b = annotators(spark, sf)
    return a.select("passage").intersect(b.select("passage"))


WORDS_CTE = f"""{V.CONT_CTE}, w AS (SELECT clip, event_id, t AS x1, t + 0.05e0 AS x2, t + (event_id % 5) / 10.0e0 AS unit_end FROM cont WHERE event_id % 4 = 1)"""


def words(spark, sf):
    frames = V.cont(spark, sf)
    return frames, frames.filter("event_id % 4 = 1").select(
        "clip", "event_id", F.col("t").alias("x1"), (F.col("t") + 0.05).alias("x2"),
        (F.col("t") + (F.col("event_id") % 5) / 10.0).alias("unit_end"))


GATHER_CTE = WORDS_CTE + """, g AS (SELECT w.clip, w.event_id, x1, x2, unit_end, c.t, {v} AS v FROM w JOIN cont c ON c.clip = w.clip
   AND c.t >= x1 - {a}e0 AND c.t <= greatest(unit_end, x2) + {b}e0 WHERE {v} IS NOT NULL)"""
CODES = ["B", "S", "D", "M", "U", "T", "H", "L", "x"]
CODE_SQL = "(['" + "', '".join(CODES) + "'][1 + CAST(c.event_id % 9 AS INT)])"


@query(f"WITH {GATHER_CTE.format(v='c.hz', a=0.05, b=0.1)} SELECT event_id, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, "
       "round(sum(v), 4) AS total FROM g GROUP BY event_id")
def c7_gather_points(spark, sf):
    frames, w = words(spark, sf)
    pts = frames.filter("hz IS NOT NULL").select("clip", "t", F.col("hz").alias("v"))
    rows = I.gather_points(w, pts, "clip", ["event_id"], 0.05, 0.1, width=0.5)
    p = F.col("points")
    return rows.select(
        "event_id", F.size(p).cast("bigint").alias("n"), F.round(F.get(p, F.lit(0))["t"], 6).alias("first_t"),
        F.round(F.get(p, F.size(p) - 1)["t"], 6).alias("last_t"),
        F.round(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x["v"]), 4).alias("total"))


RANKS = "CASE {0} WHEN 'L' THEN -1 WHEN 'B' THEN 0 WHEN 'S' THEN 1 WHEN 'D' THEN 1 WHEN 'M' THEN 2 WHEN 'U' THEN 3 WHEN 'T' THEN 4 WHEN 'H' THEN 5 END"


@query(f"""WITH {GATHER_CTE.format(v=CODE_SQL, a=0.1, b=0.3)}, k AS (SELECT event_id, count(*) AS n, count(*) FILTER (v <> 'x') AS known,
    arg_max(v, t) FILTER (v <> 'x') AS last, arg_min(v, t) FILTER (v <> 'x') AS first FROM g GROUP BY event_id),
  s AS (SELECT *, {RANKS.format('last')} - {RANKS.format('first')} AS step FROM k)
  SELECT event_id, CASE WHEN n >= 2 AND known >= 2 THEN CASE WHEN step >= 1 THEN 'UP' WHEN step <= -1 THEN 'DOWN' ELSE 'FLAT' END END AS movement FROM s""")
def f15_code_movement(spark, sf):
    frames, w = words(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (1 + F.col("event_id") % 9).cast("int"))
    rows = I.gather_points(w, frames.select("clip", "t", code.alias("v")), "clip", ["event_id"], 0.1, 0.3, width=0.5)
    return rows.select("event_id", I.code_movement("points").alias("movement"))


@query(f"""WITH {GATHER_CTE.format(v='c.hz', a=0.05, b=0.1)}, k AS (SELECT event_id, count(*) AS n, arg_min(v, t) AS v0, arg_max(v, t) AS v1,
    min(t) AS t0, max(t) AS t1 FROM g GROUP BY event_id), e AS (SELECT event_id, CASE WHEN n >= 2 THEN 12 * log2(v1 / v0) END AS st, t1 - t0 AS dt FROM k)
  SELECT event_id, round(st, 4) AS semitones, round(st / greatest(dt, 0.001e0), 4) AS slope,
    CASE WHEN st / greatest(dt, 0.001e0) <= -4 THEN 'FALL' WHEN st / greatest(dt, 0.001e0) >= 4 THEN 'RISE' WHEN st IS NOT NULL THEN 'FLAT' END AS movement FROM e""")
def f16_excursion(spark, sf):
    frames, w = words(spark, sf)
    pts = frames.filter("hz IS NOT NULL").select("clip", "t", F.col("hz").alias("v"))
    rows = I.gather_points(w, pts, "clip", ["event_id"], 0.05, 0.1, width=0.5).withColumn("e", I.excursion("points"))
    return rows.select("event_id", F.round("e.semitones", 4).alias("semitones"), F.round("e.slope", 4).alias("slope"), "e.movement")


def glide_sql(low: str, high: str, name: str) -> str:
    return (f"CASE WHEN count(*) FILTER (t >= {low} AND t <= {high}) >= 2 THEN 12 * log2(arg_max(v, t) FILTER (t >= {low} AND t <= {high}) "
            f"/ arg_min(v, t) FILTER (t >= {low} AND t <= {high})) END AS {name}")


GLIDE_CTE = (GATHER_CTE.format(v='c.hz', a=0.05, b=0.1)
             + f", k AS (SELECT event_id, {glide_sql('x1 - 0.02e0', 'x2 + 0.05e0', 'a')}, {glide_sql('x2', 'unit_end + 0.05e0', 'b')} FROM g GROUP BY event_id)"
             + """, sh AS (SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE
  coalesce(CASE WHEN a <= -3 THEN 'fall' WHEN a >= 3 THEN 'rise' WHEN a IS NOT NULL THEN 'flat' END, '-') || '/' ||
  coalesce(CASE WHEN b <= -3 THEN 'fall' WHEN b >= 3 THEN 'rise' WHEN b IS NOT NULL THEN 'flat' END, '-') END AS shape FROM k)""")


def shapes(spark, sf):
    frames, w = words(spark, sf)
    pts = frames.filter("hz IS NOT NULL").select("clip", "t", F.col("hz").alias("v"))
    rows = I.gather_points(w, pts, "clip", ["event_id"], 0.05, 0.1, width=0.5)
    return rows.select("event_id", I.glide_shape(F.col("points"), F.col("x1"), F.col("x2"), F.col("unit_end")).alias("shape"))


@query(f"WITH {GLIDE_CTE} SELECT event_id, shape FROM sh")
def f17_glide_shape(spark, sf):
    return shapes(spark, sf)


@query(f"""WITH {GLIDE_CTE}, c AS (SELECT event_id % 4 + event_id % 3 AS mark, shape, count(*) AS n FROM sh WHERE shape IS NOT NULL GROUP BY ALL),
  t AS (SELECT *, sum(n) OVER (PARTITION BY mark) AS total FROM c)
  SELECT mark, shape, n, CAST(total AS BIGINT) AS total, round(n * 1.0e0 / total, 4) AS share FROM t WHERE n * 1.0e0 / total >= 0.05""")
def d21_movement_dist(spark, sf):
    rows = shapes(spark, sf).filter("shape IS NOT NULL").withColumn("mark", F.col("event_id") % 4 + F.col("event_id") % 3)
    return T.movement_dist(rows, "mark", "shape")


UNIT_CTE = f"""{V.GRID_CTE}, c AS (SELECT *, CASE WHEN contains(text, '|') OR contains(text, '#') OR text = 'END' THEN 1 ELSE 0 END AS closes FROM grid WHERE text <> ''),
  n AS (SELECT *, sum(closes) OVER (PARTITION BY path ORDER BY idx ROWS UNBOUNDED PRECEDING) - closes AS unit, ltrim(text, '<>') AS s FROM c),
  m AS (SELECT *, CASE WHEN s LIKE '`/%' THEN 'fall_rise' WHEN left(s, 1) IN (chr(92), '`') THEN 'fall' WHEN left(s, 1) = '/' THEN 'rise'
      WHEN left(s, 1) = '=' THEN 'level' END AS tone, trim(replace(ltrim(s, chr(92) || '`/='), '|', ''), ', ') AS word FROM n),
  u AS (SELECT path, CAST(unit AS BIGINT) AS unit, arg_min(xmin, idx) AS s0, arg_max(xmax, idx) AS e0, arg_max(tone, idx) FILTER (tone IS NOT NULL) AS tone,
    arg_max(xmin, idx) FILTER (tone IS NOT NULL) AS n0, string_agg(word, ' ' ORDER BY idx) FILTER (word <> '') AS transcript FROM m GROUP BY path, unit),
  units AS (SELECT path, unit, round(s0, 4) AS start_s, round(e0, 4) AS end_s, round(n0, 4) AS nucleus_s, tone AS expected_tone, coalesce(transcript, '') AS transcript
    FROM u WHERE tone IN ('fall', 'rise', 'fall_rise') AND e0 - s0 >= 0.4e0)"""


@query(f"WITH {UNIT_CTE} SELECT * FROM units")
def f18_intonation_units(spark, sf):
    hot = V.grid_hot(spark, sf)
    return I.intonation_units(V.grid(spark, sf, hot), hot=hot)


@query(f"""WITH {UNIT_CTE}, p AS (SELECT *, length(transcript) - length(replace(transcript, ' ', '')) + 1 AS n FROM units),
  b AS (SELECT *, greatest(0, CAST(floor(nucleus_s * 16000) AS BIGINT) - 1600) AS f, least(CAST(floor(9.5e0 * 16000) AS BIGINT), CAST(floor(end_s * 16000) AS BIGINT),
    CAST(floor(nucleus_s * 16000) AS BIGINT) + 7200) AS l FROM p)
  SELECT path, unit, f AS first_sample, l AS last_sample, CASE WHEN n < 2 THEN 'too few phones' WHEN l - f < 4800 THEN 'too short' END AS skip_reason FROM b""")
def f19_tone_slice(spark, sf):
    hot = V.grid_hot(spark, sf)
    units = I.intonation_units(V.grid(spark, sf, hot), hot=hot)
    rows = I.tone_slice(units, F.lit(9.5), F.size(F.split("transcript", " ")))
    return rows.select("path", "unit", "first_sample", "last_sample", "skip_reason")


@query(f"""WITH RECURSIVE {V.CONT_CTE}, b AS (SELECT clip, list(coalesce(hz, 5.0e0) ORDER BY i) AS e, count(*) AS n,
    list(struct_pack(passage := 'x' || i, duration := 0.12e0 + event_id % 9 / 50.0e0) ORDER BY i) FILTER (i % 9 = 0) AS p FROM cont GROUP BY clip),
  w AS (SELECT clip, e, n, p, 1 AS k, 0.0e0 AS cursor FROM b
    UNION ALL SELECT clip, e, n, p, k + 1, CASE WHEN high > low THEN (low + list_position(e[low + 1:high + 1], list_min(e[low + 1:high + 1])) - 1) * 0.02e0 ELSE least(prior, n * 0.02e0) END
    FROM (SELECT *, cursor + p[k].duration AS prior, CAST(greatest(trunc((cursor + 0.5e0) / 0.02e0), trunc((cursor + p[k].duration - 3.0e0) / 0.02e0)) AS BIGINT) AS low,
      CAST(least(n - 1, trunc((cursor + p[k].duration + 3.0e0) / 0.02e0)) AS BIGINT) AS high FROM w WHERE k <= len(p)) WHERE prior <= n * 0.02e0 + 2.0e0)
  SELECT clip, p[k].passage AS passage, round(cursor, 4) AS offset FROM w WHERE k <= len(p) AND cursor + p[k].duration <= n * 0.02e0 + 2.0e0""")
def f20_refine_offsets(spark, sf):
    frames = V.cont(spark, sf)
    blocks = frames.groupBy("clip").agg(
        F.sort_array(F.collect_list(F.struct("i", F.coalesce("hz", F.lit(5.0)).alias("e")))).alias("e"),
        F.sort_array(F.collect_list(F.when(F.col("i") % 9 == 0, F.struct(
            "i", F.concat(F.lit("x"), "i").alias("passage"), (0.12 + F.col("event_id") % 9 / 50.0).alias("duration"))))).alias("p"))
    energy = F.transform("e", lambda x: x["e"])
    passages = F.transform("p", lambda x: F.struct(x["passage"].alias("passage"), x["duration"].alias("duration")))
    rows = blocks.select("clip", F.explode(I.refine_offsets(passages, energy, F.size("e") * 0.02)).alias("o"))
    return rows.select("clip", "o.passage", F.round("o.offset", 4).alias("offset"))


# -- contour chain -----------------------------------------------------------------------

LOCAL_CTE = f"""{V.CONT_CTE}, ends AS (SELECT clip, min(i) AS lo, max(i) AS hi, count(hz) AS nv FROM cont GROUP BY clip),
  pad AS (SELECT clip, i, i AS p, hz FROM cont UNION ALL SELECT c.clip, c.i, c.i - k, hz FROM cont c JOIN ends e ON c.clip = e.clip AND c.i = e.lo, (SELECT unnest([1, 2, 3]) AS k)
    UNION ALL SELECT c.clip, c.i, c.i + k, hz FROM cont c JOIN ends e ON c.clip = e.clip AND c.i = e.hi, (SELECT unnest([1, 2, 3]) AS k)),
  med AS (SELECT clip, i, p, hz, median(hz) OVER (PARTITION BY clip ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS local FROM pad),
  loc AS (SELECT clip, i, hz, local FROM med WHERE p = i)"""


@query(f"WITH {LOCAL_CTE} SELECT clip, i, round(local, 5) AS local FROM loc")
def f1_rolling_median(spark, sf):
    return C.rolling_median(V.cont(spark, sf)).select("clip", "i", F.round("local", 5).alias("local"))


FIX_CTE = LOCAL_CTE + """, s1 AS (SELECT l.*, nv, abs(12 * log2(hz / local)) > 9 AND abs(12 * log2(hz * 2 / local)) < 9 AS up FROM loc l JOIN ends e ON l.clip = e.clip),
  s2 AS (SELECT *, CASE WHEN up THEN hz * 2 ELSE hz END AS b FROM s1),
  s3 AS (SELECT *, abs(12 * log2(b / local)) > 9 AND abs(12 * log2(b * 0.5e0 / local)) < 9 AS down FROM s2),
  s4 AS (SELECT *, CASE WHEN down THEN b * 0.5e0 ELSE b END AS c FROM s3),
  fixed AS (SELECT clip, i, CASE WHEN nv < 3 THEN hz WHEN NOT coalesce(abs(12 * log2(c / local)) > 9, false) THEN c END AS clean,
    CASE WHEN nv < 3 THEN 0 ELSE coalesce(up, false)::INT + coalesce(down, false)::INT + coalesce(abs(12 * log2(c / local)) > 9, false)::INT END AS touched FROM s4)"""


def cleaned(spark, sf):
    return C.fix_octaves(V.cont(spark, sf))


@query(f"WITH {FIX_CTE} SELECT clip, i, round(clean, 5) AS clean, touched FROM fixed")
def f2_fix_octaves(spark, sf):
    return cleaned(spark, sf).select("clip", "i", F.round("clean", 5).alias("clean"), "touched")


@query(f"""WITH {FIX_CTE} SELECT clip, count(*) AS frames, count(clean) AS voiced, round(count(clean) * 1.0e0 / count(*), 4) AS voiced_fraction,
  CASE WHEN count(clean) >= 3 THEN round(median(clean), 2) END AS median_hz, CASE WHEN count(clean) >= 3 THEN round(sum(touched) * 1.0e0 / count(clean), 4) END AS octave_error_rate
  FROM fixed GROUP BY clip""")
def f3_track_summary(spark, sf):
    return C.track_summary(cleaned(spark, sf))


ST_CTE = FIX_CTE + """, mh AS (SELECT clip, median(clean) AS m FROM fixed GROUP BY clip),
  st AS (SELECT f.clip, f.i, f.i * CAST(0.01 AS DOUBLE) AS t, round(12 * log2(greatest(clean, 1e-6) / m), 3) AS st FROM fixed f JOIN mh ON f.clip = mh.clip)"""


def semis(spark, sf):
    return C.semitone_frames(cleaned(spark, sf))


@query(f"WITH {ST_CTE} SELECT clip, i, st FROM st")
def b19_semitones(spark, sf):
    return semis(spark, sf).select("clip", "i", "st")


@query(f"""WITH {V.CONT_CTE}, p AS (SELECT clip, quantile_cont(hz, 0.05) AS lo, quantile_cont(hz, 0.95) AS hi FROM cont GROUP BY clip),
  f AS (SELECT *, least(greatest(0.75e0 * lo, 50), 899) AS floor_hz FROM p)
  SELECT clip, round(floor_hz, 6) AS floor_hz, round(least(greatest(1.5e0 * hi, floor_hz + 50), 900), 6) AS ceiling_hz FROM f WHERE lo IS NOT NULL""")
def f4_pitch_range(spark, sf):
    return C.pitch_range(V.cont(spark, sf)).select("clip", F.round("floor_hz", 6).alias("floor_hz"), F.round("ceiling_hz", 6).alias("ceiling_hz"))


@query(f"WITH {ST_CTE} SELECT clip, count(*) AS n, round(sum(st), 3) AS total FROM st WHERE st IS NOT NULL AND t >= 0.1 - 1e-6 AND t <= 0.4 + 1e-6 GROUP BY clip")
def f5_voiced(spark, sf):
    return C.voiced(semis(spark, sf), 0.1, 0.4).groupBy("clip").agg(F.count("*").alias("n"), F.round(F.sum("st"), 3).alias("total"))


SLOPE = "CASE WHEN count(st) {f} >= 3 AND max(t) {f} - min(t) {f} >= 1e-3 THEN round(regr_slope(st, t) {f}, 4) END"


@query(f"WITH {ST_CTE} SELECT clip, {SLOPE.format(f='FILTER (st IS NOT NULL)')} AS slope FROM st GROUP BY clip")
def f6_ols_slope(spark, sf):
    return C.ols_slope(semis(spark, sf), ["clip"]).select("clip", *r4("slope"))


@query(f"""WITH {ST_CTE}, z AS (SELECT clip, min(t) AS t0, max(t) AS t1 FROM st GROUP BY clip), v AS (SELECT st.*, t0, t1 FROM st JOIN z ON st.clip = z.clip WHERE st IS NOT NULL)
  SELECT clip, {SLOPE.format(f='')} AS whole, {SLOPE.format(f='FILTER (t >= t1 - 0.35e0)')} AS terminal, {SLOPE.format(f='FILTER (t <= t0 + 0.3e0)')} AS first03 FROM v GROUP BY clip""")
def f14_slope_windows(spark, sf):
    return C.slope_windows(semis(spark, sf)).select("clip", *r4("whole", "terminal", "first03"))


TONE_CTE = ST_CTE + """, lv AS (SELECT clip, max(t) AS e FROM st WHERE st IS NOT NULL GROUP BY clip),
  tw AS (SELECT st.clip, st.t, st.st AS v FROM st JOIN lv ON st.clip = lv.clip WHERE st IS NOT NULL AND t >= greatest(0, e - 0.35e0) - 1e-6 AND t <= e + 1e-6),
  md AS (SELECT clip, count(*) AS n, min(t) + (max(t) - min(t)) / 2.0e0 AS mid, max(t) - min(t) AS spread FROM tw GROUP BY clip),
  hv AS (SELECT tw.*, t <= mid AS h FROM tw JOIN md ON tw.clip = md.clip),
  hs AS (SELECT clip, h, count(*) AS c, max(t) - min(t) AS sp FROM hv GROUP BY clip, h),
  pr AS (SELECT a.clip, a.h AS ha, b.h AS hb, (b.v - a.v) / (b.t - a.t) AS s FROM hv a JOIN hv b ON a.clip = b.clip AND b.t - a.t > 1e-6),
  ts AS (SELECT clip, median(s) AS sl, median(s) FILTER (ha AND hb) AS s1, median(s) FILTER (NOT ha AND NOT hb) AS s2 FROM pr GROUP BY clip),
  sl AS (SELECT c.clip, coalesce(n, 0) AS n, CASE WHEN n >= 3 AND spread >= 1e-3 THEN sl END AS slope,
    CASE WHEN h1.c >= 3 AND h1.sp >= 1e-3 THEN s1 END AS first_slope, CASE WHEN h2.c >= 3 AND h2.sp >= 1e-3 THEN s2 END AS second_slope
    FROM (SELECT DISTINCT clip FROM st) c LEFT JOIN md ON c.clip = md.clip LEFT JOIN ts ON c.clip = ts.clip
    LEFT JOIN hs h1 ON c.clip = h1.clip AND h1.h LEFT JOIN hs h2 ON c.clip = h2.clip AND NOT h2.h),
  tn AS (SELECT *, CASE WHEN slope IS NULL THEN 'level' WHEN first_slope <= -12 AND second_slope >= 12 THEN 'fall_rise' WHEN slope >= 6 THEN 'rise' WHEN slope <= -4 THEN 'fall' ELSE 'level' END AS tone,
    CASE WHEN slope IS NULL THEN 0.0e0 WHEN first_slope <= -12 AND second_slope >= 12 THEN 1.0e0 ELSE least(1.0e0, abs(slope) / 12.0e0) END AS confidence FROM sl)"""


@query(f"WITH {TONE_CTE} SELECT clip, round(slope, 4) AS slope, round(first_slope, 4) AS first_slope, round(second_slope, 4) AS second_slope FROM tn")
def f7_theil_sen(spark, sf):
    return C.terminal_slopes(semis(spark, sf)).select("clip", *r4("slope", "first_slope", "second_slope"))


@query(f"WITH {TONE_CTE} SELECT clip, n, tone, round(confidence, 4) AS confidence FROM tn")
def f8_nuclear_tone(spark, sf):
    return C.nuclear_tone(semis(spark, sf)).select("clip", "n", "tone", *r4("confidence"))


RUN_CTE = ST_CTE + """, vp AS (SELECT *, lag(t) OVER (PARTITION BY clip ORDER BY i) AS pt FROM st WHERE st IS NOT NULL),
  runs AS (SELECT clip, i, t, st, CAST(sum(CASE WHEN pt IS NULL OR t - pt > 0.04e0 + 0.01e0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM vp)"""


@query(f"WITH {RUN_CTE} SELECT clip, i, run FROM runs")
def f11_voiced_runs(spark, sf):
    return C.voiced_runs(semis(spark, sf)).select("clip", "i", "run")


SMOOTH_CTE = ST_CTE + """, smooth AS (SELECT clip, i, t, median(st) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM st WHERE st IS NOT NULL)"""


@query(f"WITH {SMOOTH_CTE} SELECT clip, i, round(v, 6) AS smooth FROM smooth")
def f13_median_smooth(spark, sf):
    return C.median_smooth(semis(spark, sf)).select("clip", "i", F.round("smooth", 6).alias("smooth"))


def extreme_cte(source: str, value: str, run: str, least: int = 6) -> str:
    same = f"AND a.{run} = {{0}}.{run}" if run else ""
    return f"""pw AS (SELECT a.clip, a.t AS ta, b.t AS tb, count(*) AS c, regr_slope(m.{value}, m.t) AS s FROM {source} a JOIN {source} b ON a.clip = b.clip {same.format('b')}
      AND b.t > a.t AND b.t - a.t <= 0.25e0 + 1e-6 JOIN {source} m ON m.clip = a.clip {same.format('m')} AND m.t >= a.t AND m.t <= b.t GROUP BY ALL HAVING count(*) >= 4),
    ex0 AS (SELECT clip, min(s) AS s_min, arg_min(ta, s) AS t_min, max(s) AS s_max, arg_max(ta, s) AS t_max FROM pw GROUP BY clip),
    ex AS (SELECT c.clip, s_min, t_min, s_max, t_max FROM (SELECT clip FROM {source} GROUP BY clip HAVING count(*) >= {least}) c LEFT JOIN ex0 ON c.clip = ex0.clip)"""


@query(f"WITH {RUN_CTE}, {extreme_cte('runs', 'st', 'run')} SELECT clip, round(s_min, 4) AS s_min, round(s_max, 4) AS s_max FROM ex")
def f12_glide_extremes(spark, sf):
    runs = C.voiced_runs(semis(spark, sf))
    return C.glide_extremes(runs, "st", run="run").select("clip", *r4("s_min", "s_max"))


@query(f"WITH {SMOOTH_CTE}, {extreme_cte('smooth', 'v', '')} SELECT clip, round(s_min, 4) AS s_min, round(s_max, 4) AS s_max FROM ex")
def f12_smooth_glide(spark, sf):
    return C.glide_extremes(C.median_smooth(semis(spark, sf)), "smooth").select("clip", *r4("s_min", "s_max"))


@query(f"""WITH {V.CONT_CTE}, d AS (SELECT clip, i, coalesce(hz, 20) / 4.0e0 - 60 AS db FROM cont), p AS (SELECT clip, quantile_cont(db, 0.05) AS lo, quantile_cont(db, 0.95) AS hi,
    min(i) AS i0, max(i) AS i1 FROM d GROUP BY clip),
  g AS (SELECT *, hi - lo AS rng, lo + greatest(0.45e0 * (hi - lo), 8) AS core, lo + greatest(0.15e0 * (hi - lo), 3) AS edge FROM p),
  c AS (SELECT g.clip, any_value(rng) AS rng, any_value(edge) AS edge, any_value(i0) AS i0, any_value(i1) AS i1, min(i) FILTER (db > core) AS f, max(i) FILTER (db > core) AS l FROM d JOIN g ON d.clip = g.clip GROUP BY g.clip),
  e AS (SELECT c.clip, any_value(rng) AS rng, any_value(f) AS f, coalesce(max(i) FILTER (i < f AND db <= edge) + 1, any_value(i0)) AS a,
     coalesce(min(i) FILTER (i > l AND db <= edge) - 1, any_value(i1)) AS b, any_value(i1) AS i1 FROM d JOIN c ON d.clip = c.clip GROUP BY c.clip),
  s AS (SELECT clip, rng, f, greatest(0.0e0, a * 0.01e0 - 0.08e0) AS st, least((i1 + 1) * 0.01e0, b * 0.01e0 + 0.025e0 + 0.08e0) AS en FROM e)
  SELECT clip, CASE WHEN rng >= 6 AND f IS NOT NULL AND en - st >= 0.08e0 THEN round(st, 4) END AS start_s,
    CASE WHEN rng >= 6 AND f IS NOT NULL AND en - st >= 0.08e0 THEN round(en, 4) END AS end_s, round(rng, 1) AS snr_db FROM s""")
def g2_speech_interval(spark, sf):
    frames = V.cont(spark, sf).select("clip", "i", (F.coalesce("hz", F.lit(20.0)) / 4.0 - 60.0).alias("db"))
    return C.speech_interval(frames)


# -- exams and grids -------------------------------------------------------------------------

BLOCK_CTE = """blk AS (SELECT block, CASE WHEN rk <= greatest(1, n // 5) THEN 'test' WHEN rk <= 2 * greatest(1, n // 5) THEN 'cal' ELSE 'train' END AS split FROM
   (SELECT block, row_number() OVER (ORDER BY md5('42:blocks:' || block)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM {0})))"""
BARS = """SELECT *, CASE WHEN kind = 'all' THEN accuracy >= 0.9e0 END AS accuracy_met, CASE WHEN kind = 'all' THEN coalesce(mean_octave_error_rate < 0.02e0, false) END AS octave_met,
  CASE WHEN kind = 'all' THEN accuracy >= 0.9e0 AND coalesce(mean_octave_error_rate < 0.02e0, false) END AS met FROM t"""


@query(f"""WITH {V.ANN_CTE}, {BLOCK_CTE.format('ann')}, r AS (SELECT *, detected = expected_tone AS ok FROM ann WHERE detected IS NOT NULL AND block IN (SELECT block FROM blk WHERE split = 'test')),
  t AS (SELECT 'tone' AS kind, expected_tone AS name, count(*) AS n, round(count(*) FILTER (ok) * 1.0e0 / count(*), 4) AS accuracy, CAST(NULL AS DOUBLE) AS mean_octave_error_rate FROM r WHERE expected_tone <> 'level' GROUP BY expected_tone
   UNION ALL SELECT 'annotator', annotator, count(*), round(count(*) FILTER (ok) * 1.0e0 / count(*), 4), NULL FROM r WHERE expected_tone IN ('fall', 'rise') GROUP BY annotator
   UNION ALL SELECT 'all', '', count(*) FILTER (expected_tone IN ('fall', 'rise')), round(count(*) FILTER (ok AND expected_tone IN ('fall', 'rise')) * 1.0e0 / count(*) FILTER (expected_tone IN ('fall', 'rise')), 4), round(avg(octave_error_rate), 5) FROM r) {BARS}""")
def d15_tone_exam(spark, sf):
    rows = V.ann(spark, sf)
    return T.tone_exam(rows, S.split_blocks(rows))


TAKE_CTE = f"""{V.ANN_CTE}, tk AS (SELECT *, CASE WHEN unit_id % 17 = 1 THEN 'excluded' WHEN detected IS NULL THEN 'unvoiced' ELSE 'ok' END AS status FROM ann)"""


def takes(spark, sf):
    status = F.when(F.col("unit_id") % 17 == 1, "excluded").when(F.col("detected").isNull(), "unvoiced").otherwise("ok")
    return V.ann(spark, sf).withColumn("status", status)


@query(f"""WITH {TAKE_CTE}, r AS (SELECT *, detected = expected_tone AS ok FROM tk WHERE status = 'ok'),
  t AS (SELECT 'tone' AS kind, expected_tone AS name, count(*) AS n, round(count(*) FILTER (ok) * 1.0e0 / count(*), 4) AS accuracy, CAST(NULL AS DOUBLE) AS mean_octave_error_rate FROM r GROUP BY expected_tone
   UNION ALL SELECT 'all', '', count(*) FILTER (expected_tone IN ('fall', 'rise')), round(count(*) FILTER (ok AND expected_tone IN ('fall', 'rise')) * 1.0e0 / count(*) FILTER (expected_tone IN ('fall', 'rise')), 4), round(avg(octave_error_rate), 5) FROM r) {BARS}""")
def d16_takes_exam(spark, sf):
    return T.takes_exam(takes(spark, sf))


@query(f"WITH {TAKE_CTE} SELECT passage, unit_id, l_linenumber, l_suppkey, status, detected, expected_tone FROM tk WHERE status <> 'excluded' AND (status <> 'ok' OR detected <> expected_tone)")
def d16_takes_flags(spark, sf):
    return T.takes_flags(takes(spark, sf)).select(*ANN_ID, "status", "detected", "expected_tone")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def d19_char_census(spark, sf):
    return T.char_census(V.table(spark, sf, "documents"), "text")


@query(r"SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE regexp_matches(ch, '[^\p{L}\p{N} .]') GROUP BY ch")
def d19_nonword_census(spark, sf):
    return T.char_census(V.table(spark, sf, "documents"), "text", r"[\p{L}\p{N} .]")


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '\s+')) AS context FROM documents),
  h AS (SELECT ch, context, count(*) AS n FROM w, (SELECT unnest(['#', ',', '''', '@', 'é']) AS ch) WHERE contains(context, ch) GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY n DESC, context) AS rank FROM h) WHERE rank <= 12""")
def d20_char_contexts(spark, sf):
    return T.char_contexts(V.table(spark, sf, "documents"), "text", ["#", ",", "'", "@", "é"], 12)


def labelled_slopes(spark, sf):
    """Terminal slopes of each clip with its expected tone and block."""
    facts = V.table(spark, sf, "events").select(F.col("user_id").alias("clip")).distinct().select(
        "clip", F.when(F.col("clip") % 3 == 0, "fall").when(F.col("clip") % 3 == 1, "rise").otherwise("fall_rise").alias("expected_tone"),
        (F.col("clip") % 11).alias("block"))
    return facts, facts.join(C.terminal_slopes(semis(spark, sf)), "clip")


LAB_CTE = TONE_CTE + """, ls AS (SELECT *, CASE clip % 3 WHEN 0 THEN 'fall' WHEN 1 THEN 'rise' ELSE 'fall_rise' END AS expected_tone, clip % 11 AS block FROM tn)"""


@query(f"""WITH {LAB_CTE}, o AS (SELECT expected_tone, slope, row_number() OVER (PARTITION BY expected_tone ORDER BY slope) - 1 AS k, count(*) OVER (PARTITION BY expected_tone) AS n FROM ls WHERE slope IS NOT NULL)
  SELECT expected_tone, any_value(n) AS n, round(min(slope), 4) AS minimum, round(max(slope) FILTER (k = n // 10), 4) AS p10, round(max(slope) FILTER (k = n // 4), 4) AS p25, round(median(slope), 4) AS median,
   round(max(slope) FILTER (k = 3 * n // 4), 4) AS p75, round(max(slope) FILTER (k = 9 * n // 10), 4) AS p90 FROM o GROUP BY expected_tone""")
def d22_class_quantiles(spark, sf):
    return T.class_quantiles(labelled_slopes(spark, sf)[1], ["expected_tone"], "slope")


def axis_sql(name: str, values: list[int]) -> str:
    return f"(SELECT unnest({values}) AS {name})"


@query(f"""WITH {LAB_CTE}, r AS (SELECT lo, hi, expected_tone, CASE WHEN slope <= -lo THEN 'fall' WHEN slope >= hi THEN 'rise' END AS p
    FROM ls, {axis_sql('lo', list(range(2, 21)))}, {axis_sql('hi', list(range(2, 21)))} WHERE expected_tone IN ('fall', 'rise') AND slope IS NOT NULL)
  SELECT lo, hi, count(p) AS answered, round(count(*) FILTER (p = expected_tone) * 1.0e0 / count(p), 6) AS accuracy, round(count(p) * 1.0e0 / count(*), 6) AS coverage
  FROM r GROUP BY lo, hi HAVING count(p) > 0""")
def d23_grid2(spark, sf):
    rows = T.grid2(labelled_slopes(spark, sf)[1], "slope", list(range(2, 21)), list(range(2, 21)))
    return rows.select("lo", "hi", "answered", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {LAB_CTE}, r AS (SELECT lo, hi, expected_tone, CASE WHEN slope <= -lo THEN 'fall' WHEN slope >= hi THEN 'rise' END AS p
    FROM ls, {axis_sql('lo', list(range(2, 21)))}, {axis_sql('hi', list(range(2, 21)))} WHERE expected_tone IN ('fall', 'rise') AND slope IS NOT NULL)
  SELECT lo, hi, count(p) AS answered, round(count(*) FILTER (p = expected_tone) * 1.0e0 / count(p), 6) AS accuracy, round(count(p) * 1.0e0 / count(*), 6) AS coverage
  FROM r GROUP BY lo, hi HAVING count(p) > 0 ORDER BY count(*) FILTER (p = expected_tone) * 1.0e0 / count(p) DESC, lo, hi LIMIT 1""")
def d23_grid2_best(spark, sf):
    rows = T.grid2_best(labelled_slopes(spark, sf)[1], "slope", list(range(2, 21)), list(range(2, 21)))
    return rows.select("lo", "hi", "answered", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


RULED = """CASE WHEN slope IS NULL THEN 'none' WHEN first_slope <= -half AND second_slope >= half THEN 'fall_rise' WHEN slope >= rise THEN 'rise'
     WHEN slope <= -fall THEN 'fall' ELSE 'level' END"""


@query(f"""WITH {LAB_CTE}, bt AS (SELECT fall, rise, half FROM ls, {axis_sql('fall', T.FALLS)}, {axis_sql('rise', T.RISES)}, {axis_sql('half', T.HALVES)}
    WHERE expected_tone IN ('fall', 'rise') GROUP BY ALL ORDER BY avg(CASE WHEN {RULED} = expected_tone THEN 1 ELSE 0 END) DESC, fall DESC, rise DESC, half DESC LIMIT 1)
  SELECT clip, expected_tone, {RULED} AS detected FROM ls, bt WHERE expected_tone IN ('fall', 'rise') AND {RULED} <> expected_tone""")
def d24_grid3_misses(spark, sf):
    rows = labelled_slopes(spark, sf)[1].filter(F.col("expected_tone").isin("fall", "rise"))
    return T.grid3_misses(rows).select("clip", "expected_tone", "detected")


@query(f"""WITH {LAB_CTE}, r AS (SELECT fall, rise, half, CASE WHEN slope IS NULL THEN 0 WHEN CASE WHEN first_slope <= -half AND second_slope >= half THEN 'fall_rise' WHEN slope >= rise THEN 'rise'
     WHEN slope <= -fall THEN 'fall' ELSE 'level' END = expected_tone THEN 1 ELSE 0 END AS ok
    FROM ls, {axis_sql('fall', T.FALLS)}, {axis_sql('rise', T.RISES)}, {axis_sql('half', T.HALVES)} WHERE expected_tone IN ('fall', 'rise'))
  SELECT fall, rise, half, round(avg(ok), 6) AS accuracy FROM r GROUP BY ALL ORDER BY avg(ok) DESC, fall DESC, rise DESC, half DESC LIMIT 12""")
def d24_grid3(spark, sf):
    rows = labelled_slopes(spark, sf)[1].filter(F.col("expected_tone").isin("fall", "rise"))
    return T.grid3(rows).withColumn("accuracy", F.round("accuracy", 6))


GLIDE_SWEEP = """pl AS (SELECT expected_tone, CASE WHEN split = 'test' THEN 'test' ELSE 'fit' END AS pool, s_min, s_max FROM ex
     JOIN (SELECT DISTINCT clip, CASE clip % 3 WHEN 0 THEN 'fall' WHEN 1 THEN 'rise' ELSE 'fall_rise' END AS expected_tone, block FROM cont) f ON f.clip = ex.clip JOIN blk ON blk.block = f.block),
  pd AS (SELECT pool, th AS threshold, expected_tone, CASE WHEN s_min IS NOT NULL AND s_min <= -th AND (s_max IS NULL OR abs(s_min) >= abs(s_max)) THEN 'fall' WHEN s_max >= th THEN 'rise' END AS p
     FROM pl, (SELECT unnest(range(2, 31)) AS th) WHERE expected_tone IN ('fall', 'rise') AND (s_min IS NOT NULL OR s_max IS NOT NULL)),
  sw AS (SELECT pool, threshold, count(p) AS answered, CASE WHEN count(p) > 0 THEN round(count(*) FILTER (p = expected_tone) * 1.0e0 / count(p), 4) ELSE 0 END AS accuracy,
     coalesce(round(count(*) FILTER (p = 'fall' AND expected_tone = 'fall') * 1.0e0 / nullif(count(p) FILTER (expected_tone = 'fall'), 0), 4), 0) AS fall_recall,
     coalesce(round(count(*) FILTER (p = 'rise' AND expected_tone = 'rise') * 1.0e0 / nullif(count(p) FILTER (expected_tone = 'rise'), 0), 4), 0) AS rise_recall FROM pd GROUP BY ALL)
  SELECT *, threshold = (SELECT threshold FROM sw WHERE pool = 'fit' ORDER BY accuracy DESC, threshold LIMIT 1) AS chosen FROM sw"""


@query(f"WITH {SMOOTH_CTE}, {extreme_cte('smooth', 'v', '')}, {BLOCK_CTE.format('cont')}, {GLIDE_SWEEP}")
def d25_glide_sweep(spark, sf):
    facts, _ = labelled_slopes(spark, sf)
    extremes = C.glide_extremes(C.median_smooth(semis(spark, sf)), "smooth")
    rows = extremes.join(facts, "clip").join(S.split_blocks(facts), "block")
    return T.glide_sweep(rows)


@query(f"""WITH {TONE_CTE}, src AS (SELECT clip, t, st FROM st WHERE st IS NOT NULL), {extreme_cte('src', 'st', '', 3)},
  z AS (SELECT clip, min(t) AS t0, max(t) AS t1 FROM st GROUP BY clip), v AS (SELECT st.*, t0, t1 FROM st JOIN z ON st.clip = z.clip WHERE st IS NOT NULL),
  w AS (SELECT clip, {SLOPE.format(f='')} AS whole, {SLOPE.format(f='FILTER (t >= t1 - 0.35e0)')} AS terminal FROM v GROUP BY clip),
  e AS (SELECT tn.*, CASE clip % 3 WHEN 0 THEN 'fall' WHEN 1 THEN 'rise' ELSE 'fall_rise' END AS expected_tone FROM tn)
  SELECT e.clip, expected_tone, tone, round(slope, 4) AS slope, round(first_slope, 4) AS first_slope, round(second_slope, 4) AS second_slope, whole, terminal,
    round(CASE WHEN abs(s_min) > abs(s_max) THEN s_min ELSE s_max END, 4) AS steepest, n FROM e LEFT JOIN w ON e.clip = w.clip LEFT JOIN ex ON e.clip = ex.clip WHERE tone <> expected_tone""")
def d33_mismatch_report(spark, sf):
    facts, _ = labelled_slopes(spark, sf)
    return T.mismatch_report(semis(spark, sf), facts)
