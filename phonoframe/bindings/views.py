"""The test views: driver tables seen as tokens, posteriors, contours, intervals.

Each view exists twice: as a DataFrame builder and as the SQL text that the checks
inline as a CTE. Plain projections share one SQL text; order-dependent columns are
written separately on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.operators.ranks import hot_keys, row_index, running
from phonoframe.operators.storage import settle

TARGET = "ð"
CONFUSIONS = ["z", "d", "v"]
A, B, THR = 1.5, 0.0, 0.75
HA, HB, HTHR = 1.2, 0.1, 0.8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, *names: str, **frames: DataFrame) -> DataFrame:
    frames = {**{n: table(spark, sf, n) for n in names}, **frames}
    return spark.sql(sql, **frames)


# -- LI: token records ---------------------------------------------------------------

LI_UTTERANCE = "concat('u', CAST(l_orderkey AS STRING)) AS utterance_id"
LI_COLUMNS = """l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate,
  concat('u', CAST(l_orderkey AS STRING)) AS utterance_id,
  CASE WHEN l_orderkey % 50 <> 7 THEN concat('s', CAST(s_suppkey AS STRING)) END AS speaker,
  lower(r_name) AS l1,
  CASE WHEN l_orderkey % 3 = 0 THEN 'native' ELSE 'open' END AS corpus,
  CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'test' ELSE 'train' END
       ELSE '' END AS native_split,
  CASE l_partkey % 7 WHEN 0 THEN 'z' WHEN 1 THEN 'd' WHEN 2 THEN 'v' WHEN 3 THEN 's'
       ELSE 'ð' END AS phone,
  CASE l_returnflag WHEN 'R' THEN 'substituted' WHEN 'A' THEN 'deleted' ELSE 'correct' END AS label,
  CASE WHEN l_returnflag = 'R' THEN CASE l_partkey % 5 WHEN 0 THEN 'z' WHEN 1 THEN 'd'
       WHEN 2 THEN 'θ' WHEN 3 THEN 'z' END END AS substituted_with,
  CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_returnflag IN ('R', 'A') THEN 0.8e0 ELSE -0.8e0 END
       + ((l_partkey * 7919) % 1000) / 250.0e0 - 2.0e0 END AS score,
  CASE WHEN l_linenumber <> 7 THEN 1.1e0 * (CASE WHEN l_returnflag IN ('R', 'A') THEN 0.8e0
       ELSE -0.8e0 END + ((l_partkey * 7919) % 1000) / 250.0e0 - 2.0e0) END AS spike_score,
  CASE WHEN l_linenumber <> 7 THEN ((31 * l_suppkey + l_partkey) % 11) / 10.0e0 END AS vote_fraction,
  CASE WHEN l_linenumber < 6 THEN -((l_partkey % 100) / 20.0e0) END AS gop,
  CASE WHEN l_linenumber <> 7 THEN CASE WHEN l_partkey % 3 = 0 THEN 'd' ELSE 'z' END END AS best_confusion,
  CASE WHEN l_linenumber <> 7 THEN CASE
       WHEN ((31 * l_partkey) % 1000) + CASE l_returnflag WHEN 'N' THEN 300 ELSE 0 END > 420 THEN
         CASE l_returnflag WHEN 'R' THEN CASE l_partkey % 5 WHEN 1 THEN 'd' WHEN 2 THEN 'θ' ELSE 'z' END
         ELSE 'ð' END
       ELSE 'v' END END AS heard,
  CASE WHEN l_linenumber <> 7 THEN ((31 * l_partkey) % 1000) / 200.0e0 - 1.0e0 END AS hearing_score,
  CASE WHEN l_quantity < 4 THEN 'failed' WHEN l_quantity < 9 THEN 'low_confidence' ELSE 'ok' END AS alignment,
  CASE WHEN l_quantity < 2 THEN 'clipping' WHEN l_quantity < 3 THEN 'no speech detected in the recording'
       WHEN l_quantity < 4 THEN 'alignment confidence below the usable floor' END AS reason,
  l_quantity < 3 AS audio_problem,
  l_quantity AS start_s,
  l_quantity + (1 + l_partkey % 40) / 200.0e0 AS end_s,
  1.0e0 - l_discount AS alignment_confidence,
  l_extendedprice AS wall_ms,
  concat('audio/u', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_',
         CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING), '.wav') AS audio_path"""
LI_FROM = """FROM {lineitem}
JOIN {supplier} ON s_suppkey = l_orderkey % (SELECT count(*) FROM {supplier})
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""
LI_SQL = f"\nSELECT {LI_COLUMNS}\n{LI_FROM}"
LI_TABLES = ["lineitem", "supplier", "nation", "region"]
LI_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def li(spark: SparkSession, sf: str) -> DataFrame:
    """Token records without the token index."""
    return view(spark, sf, LI_SQL, *LI_TABLES)


def li_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the tables with ``utterance_id`` and the 0-based ``token_index`` inside the utterance."""
    bucket = F.struct("l_linenumber", F.expr("l_partkey div 64").alias("part"))
    joined = view(spark, sf, f"SELECT l.*, s_suppkey, r_name, {LI_UTTERANCE} {LI_FROM.replace('{lineitem}', '{lineitem} l')}", *LI_TABLES)
    rows = row_index(joined, ["utterance_id"], LI_ORDER, bucket, "_n", sparse=True)
    return rows.withColumn("token_index", F.col("_n") - 1).drop("_n")


def li_records(spark: SparkSession, rows: DataFrame, *more: str) -> DataFrame:
    """Token records, which are wide, of numbered rows of the tables."""
    columns = ", ".join([LI_COLUMNS.replace(LI_UTTERANCE, "utterance_id"), "token_index", *more])
    return spark.sql(f"SELECT {columns} FROM {{rows}}", rows=rows)


def li_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Token records with the 0-based token index inside the utterance."""
    return li_records(spark, li_numbered(spark, sf))


LI_CTE = "li0 AS (" + LI_SQL.format(**{t: t for t in LI_TABLES}) + ")"
LI_INDEXED_CTE = (
    LI_CTE + ", li AS (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY "
    + ", ".join(LI_ORDER) + ") - 1 AS token_index FROM li0)"
)


def bucket_sql(key: str) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 100)"


SPLIT_CTE = f"""
spk AS (SELECT l1, speaker, row_number() OVER (PARTITION BY l1
          ORDER BY md5(concat_ws(':', '42:l1', l1, speaker))) AS rk
        FROM (SELECT DISTINCT l1, speaker FROM li WHERE speaker IS NOT NULL)),
lis AS (SELECT li.*, CASE
    WHEN corpus = 'native' THEN CASE WHEN native_split = 'test' THEN 'test'
      WHEN {bucket_sql("concat_ws(':', '42', 'cal', utterance_id)")} < 25 THEN 'cal' ELSE 'train' END
    WHEN li.speaker IS NOT NULL THEN CASE rk WHEN 1 THEN 'test' WHEN 2 THEN 'cal' ELSE 'train' END
    WHEN {bucket_sql("concat_ws(':', '42', 'any', utterance_id)")} < 30 THEN 'test' ELSE 'train' END AS split
  FROM li LEFT JOIN spk ON li.l1 = spk.l1 AND li.speaker = spk.speaker)"""


def li_split(spark: SparkSession, sf: str, indexed: bool = False) -> DataFrame:
    from phonoframe.operators.splits import assign_split

    rows = li(spark, sf)
    roster = rows.filter("speaker IS NOT NULL AND l1 IS NOT NULL").select("speaker", "l1").distinct()
    return assign_split(li_indexed(spark, sf) if indexed else rows, roster)


LI_SPLIT_CTE = LI_CTE + ", li AS (SELECT * FROM li0), " + SPLIT_CTE
LI_INDEXED_SPLIT_CTE = LI_INDEXED_CTE + ", " + SPLIT_CTE


# -- CONT: pitch contours ---------------------------------------------------------------

CONT_SQL = """
SELECT user_id AS clip, event_id, ts,
  CASE WHEN event_type <> 'error' THEN 60.0e0 + 1.4142135e0 * value
       * CASE WHEN event_id % 37 = 0 THEN 2.0e0 WHEN event_id % 41 = 0 THEN 0.5e0 ELSE 1.0e0 END END AS hz,
  CASE user_id % 3 WHEN 0 THEN 'fall' WHEN 1 THEN 'rise' ELSE 'fall_rise' END AS tone,
  user_id % 11 AS block
FROM {events}
"""


def cont(spark: SparkSession, sf: str) -> DataFrame:
    """Frames (clip, i, t, hz, tone, block); hz is null on unvoiced frames."""
    rows = view(spark, sf, CONT_SQL, "events")
    ranked = row_index(rows, ["clip"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "_n", sparse=True)
    return settle(ranked.select(
        "clip", (F.col("_n") - 1).alias("i"), ((F.col("_n") - 1) * F.lit(0.01)).alias("t"),
        "hz", "tone", "block", "event_id"))


CONT_CTE = (
    "cont0 AS (" + CONT_SQL.format(events="events") + "), "
    "cont AS (SELECT clip, i, i * CAST(0.01 AS DOUBLE) AS t, hz, tone, block, event_id FROM (SELECT *, "
    "row_number() OVER (PARTITION BY clip ORDER BY ts, event_id) - 1 AS i FROM cont0))"
)

# -- GRID: labelled intervals ----------------------------------------------------------

GRID_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity,
  concat('p', CAST(l_orderkey AS STRING)) AS path,
  concat(CASE WHEN l_suppkey % 7 = 0 THEN '<' ELSE '' END,
         CASE l_partkey % 6 WHEN 0 THEN '\\\\' WHEN 1 THEN '`/' WHEN 2 THEN '/' WHEN 3 THEN '`'
              WHEN 4 THEN '=' ELSE '' END,
         'w', CAST(l_partkey % 17 AS STRING),
         CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_partkey % 2 = 0 THEN '|' ELSE ',||' END
              ELSE '' END) AS text
FROM {lineitem}
"""
GRID_SQL_DUCK = GRID_SQL.replace("\\\\", "\\")


def grid_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The paths of very many words."""
    return hot_keys(view(spark, sf, GRID_SQL, "lineitem"), ["path"])


def grid(spark: SparkSession, sf: str, hot: DataFrame | None = None) -> DataFrame:
    """Word intervals (path, idx, xmin, xmax, text) laid end to end."""
    rows = view(spark, sf, GRID_SQL, "lineitem")
    bucket = F.struct("l_linenumber", F.expr("l_partkey div 64").alias("part"))
    sums = {"_upto": F.col("l_quantity"), "_n": F.lit(1).cast("bigint")}
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    laid = running(rows, ["path"], order, sums, bucket, True if hot is None else hot)
    return laid.select(
        "path", (F.col("_n") - 1).alias("idx"),
        ((F.col("_upto") - F.col("l_quantity")) / 20.0).alias("xmin"),
        (F.col("_upto") / 20.0).alias("xmax"), "text", "l_orderkey", "l_partkey", "l_suppkey")


GRID_CTE = (
    "grid0 AS (" + GRID_SQL_DUCK.format(lineitem="lineitem") + "), "
    "grid AS (SELECT path, n - 1 AS idx, (upto - l_quantity) / 20.0e0 AS xmin, upto / 20.0e0 AS xmax, "
    "text, l_orderkey, l_partkey, l_suppkey FROM (SELECT *, "
    "row_number() OVER w AS n, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM grid0 "
    "WINDOW w AS (PARTITION BY path ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)))"
)

# -- ANN: two annotators ---------------------------------------------------------------

ANN_SQL = """
SELECT l_orderkey AS passage, l_partkey AS unit_id, l_linenumber, l_suppkey,
  CASE WHEN l_suppkey % 2 = 1 THEN 'B' ELSE 'G' END AS annotator,
  l_quantity * 0.13e0 AS start_s,
  l_quantity * 0.13e0 + 0.5e0 + (l_partkey % 20) / 50.0e0 AS end_s,
  CASE l_partkey % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall_rise' ELSE 'fall' END AS expected_tone,
  CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 13 < 10 THEN
    CASE l_partkey % 4 WHEN 0 THEN 'rise' WHEN 1 THEN 'fall_rise' ELSE 'fall' END
    ELSE 'level' END AS detected,
  CASE WHEN l_partkey % 10 <> 3 THEN (l_partkey % 50) / 1000.0e0 END AS octave_error_rate,
  CASE WHEN l_partkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS alignment,
  l_suppkey % 13 AS block,
  concat(CASE l_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '`' WHEN 2 THEN '*' WHEN 3 THEN '~' ELSE '' END,
         'w', CAST(l_suppkey % 7 AS STRING)) AS text
FROM {lineitem}
"""


def ann(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, ANN_SQL, "lineitem")


ANN_CTE = "ann AS (" + ANN_SQL.format(lineitem="lineitem") + ")"

# -- POST: packed posteriors ---------------------------------------------------------------

POST_SQL = """
SELECT vec_id AS utt, embedding, label AS klass, vec_id % 6 AS l1,
  1 + label % 7 AS target,
  CASE label WHEN 7 THEN 'substituted' WHEN 8 THEN 'substituted' WHEN 9 THEN 'deleted'
       ELSE 'correct' END AS label,
  CASE label WHEN 7 THEN 1 + (label % 7 + 1) % 7 END AS substituted_with,
  CASE WHEN vec_id % 10 < 9 THEN CASE label WHEN 7 THEN 1 + (label % 7 + 1) % 7
       WHEN 8 THEN 0 WHEN 9 THEN 0 ELSE 1 + label % 7 END
       ELSE 1 + (label % 7 + 2) % 7 END AS hint
FROM {embeddings}
"""
POST_TOKENS = 8
POST_FRAMES = 8
LABEL_FRAMES = [1, 2, 3, 4, 5]


def post(spark: SparkSession, sf: str) -> DataFrame:
    """One row per utterance: logits as array<array<double>> [frame][token]."""
    rows = view(spark, sf, POST_SQL, "embeddings")
    frames = F.transform(
        F.sequence(F.lit(0), F.lit(POST_FRAMES - 1)),
        lambda t: F.transform(
            F.slice("embedding", t * POST_TOKENS + 1, F.lit(POST_TOKENS)),
            lambda x, i: x.cast("double") * 20.0 + F.when(i == F.col("hint"), 6.0).otherwise(0.0),
        ),
    )
    closed = F.array(*[F.lit(1) + (F.col("klass") % 7 + k) % 7 for k in range(1, 4)])
    return rows.select(
        "utt", "klass", "l1", F.col("target").cast("int"), "label", "substituted_with", "hint",
        frames.alias("logits"), closed.cast("array<int>").alias("confusions"),
        F.array(*[F.lit(f) for f in LABEL_FRAMES]).alias("label_frames"),
        F.lit(0.02).alias("hop_s"))


POST_CTE = (
    "post0 AS (" + POST_SQL.format(embeddings="embeddings") + "), "
    "logit AS (SELECT utt, klass, target, label, l1, substituted_with, hint, k // 8 AS t, k % 8 AS token, "
    "20.0e0 * CAST(embedding[k + 1] AS DOUBLE) + CASE WHEN k % 8 = hint THEN 6.0e0 ELSE 0.0e0 END AS x "
    "FROM post0, (SELECT unnest(range(64)) AS k)), "
    "frame AS (SELECT utt, t, max(x) AS mx FROM logit GROUP BY utt, t), "
    "norm AS (SELECT l.utt, l.t, max(mx) AS mx, max(mx) + ln(sum(exp(x - mx))) AS lse FROM logit l "
    "JOIN frame f ON l.utt = f.utt AND l.t = f.t GROUP BY l.utt, l.t), "
    "logp AS (SELECT l.* EXCLUDE (x), x - lse AS logp FROM logit l JOIN norm n ON l.utt = n.utt AND l.t = n.t)"
)



def path_cte(targets: list[str]) -> str:
    """Best CTC path of every utterance over states (blank, target, blank, ...), frame by frame; neighbouring
    targets differ. Ties keep the smaller step. Ends in ``path`` (utt, t, s)."""
    last = 2 * len(targets)
    symbols = " ".join(f"WHEN {2 * k + 1} THEN {sql}" for k, sql in enumerate(targets))
    steps = [
        f"em AS MATERIALIZED (SELECT st.utt, s, t, logp FROM (SELECT utt, s, CASE s {symbols} ELSE 0 END AS token FROM post0, "
        f"(SELECT unnest(range({last + 1})) AS s)) st JOIN logp ON logp.utt = st.utt AND logp.token = st.token)",
        "d0 AS MATERIALIZED (SELECT utt, s, logp AS v, 0 AS back FROM em WHERE t = 0 AND s < 2)"]
    for t in range(1, POST_FRAMES):
        steps.append(
            f"d{t} AS MATERIALIZED (SELECT p.utt, p.s, p.m.v + e.logp AS v, -p.m.k AS back FROM (SELECT utt, s + k AS s, "
            f"max({{'v': v, 'k': -k}}) AS m FROM d{t - 1}, (SELECT unnest([0, 1, 2]) AS k) WHERE k < 2 OR s % 2 = 1 "
            f"GROUP BY ALL) p JOIN em e ON e.utt = p.utt AND e.s = p.s AND e.t = {t})")
    end = POST_FRAMES - 1
    steps.append(
        f"p{end} AS MATERIALIZED (SELECT utt, CASE WHEN coalesce(max(v) FILTER (s = {last - 1}) > max(v) FILTER (s = {last}), true) "
        f"THEN {last - 1} ELSE {last} END AS s FROM d{end} GROUP BY utt HAVING max(s) >= {last - 1})")
    for t in range(end - 1, -1, -1):
        steps.append(f"p{t} AS MATERIALIZED (SELECT p.utt, p.s - back AS s FROM p{t + 1} p JOIN d{t + 1} d ON d.utt = p.utt AND d.s = p.s)")
    whole = " UNION ALL ".join(f"SELECT utt, {t} AS t, s FROM p{t}" for t in range(POST_FRAMES))
    return ", ".join([*steps, f"path AS MATERIALIZED ({whole})"])


# -- SIG: signals ------------------------------------------------------------------------

SIG_RATE = 16_000


def sig(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of 32 consecutive vectors (2048 samples); the group size is fixed."""
    rows = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 32").alias("sig"), "vec_id", "embedding")
    packed = rows.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    samples = F.flatten(F.transform("v", lambda e: e["embedding"]))
    return packed.select(
        "sig", F.transform(samples, lambda x: x.cast("double") * 2.0).alias("samples"),
        F.lit(SIG_RATE).alias("rate"))


SIG_CTE = (
    "sig AS (SELECT vec_id // 32 AS sig, (vec_id % 32) * 64 + k AS pos, "
    "CAST(embedding[k + 1] AS DOUBLE) * 2.0e0 AS x "
    "FROM embeddings, (SELECT unnest(range(64)) AS k))"
)
