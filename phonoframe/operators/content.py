"""Exercises: rule checks, catalog and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import normalize_phone

SEGMENTAL = ("minimal_pair", "word", "sentence")
ID_PATTERN = r"^[a-z0-9]+(\.[a-z0-9-]+)+$"
REQUIRED = ["id", "type", "title", "lang", "text", "ipa", "reference_audio"]


def escapes_root(path: Column) -> Column:
    """Whether a relative path leaves its folder: some prefix has more '..' than names."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def walk(acc: Column, step: Column) -> Column:
        depth = acc["depth"] + F.when(step == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["out"] | (depth < 0)).alias("out"))

    return path.startswith("/") | F.aggregate(steps, start, walk, lambda acc: acc["out"])


def validate_exercises(df: DataFrame) -> DataFrame:
    """Violations as (id, rule) rows; a sound pack gives none."""
    phones = F.col("phones")
    focused = F.filter(phones, lambda p: F.coalesce(p["focus"], F.lit(False)))
    segmental = F.col("type").isin(*SEGMENTAL)
    labels = F.concat(
        F.transform(phones, lambda p: p["ph"]),
        F.flatten(F.transform(phones, lambda p: F.coalesce(p["confusions"], F.array().cast("array<string>")))))
    rules = {
        "missing field": F.exists(F.array(*[F.col(c) for c in REQUIRED]), lambda v: v.isNull()),
        "bad id": ~F.col("id").rlike(ID_PATTERN),
        "unknown type": ~F.col("type").isin(*SEGMENTAL, "intonation"),
        "no phones": F.size(phones) == 0,
        "unmappable phone": F.exists(labels, lambda p: normalize_phone(p).isNull()),
        "needs exactly one focus phone": segmental & (F.size(focused) != 1),
        "focus phone needs confusions": segmental & (F.size(focused) == 1) & F.exists(
            focused, lambda p: F.coalesce(F.size(p["confusions"]), F.lit(0)) <= 0),
        "intonation needs prosody": (F.col("type") == "intonation") & F.col("prosody").isNull(),
        "unknown tone": F.col("prosody").isNotNull() & ~F.col("prosody.expected_tone").isin(*K.TONES),
        "negative syllable": F.col("prosody.nuclear_syllable_index") < 0,
        "audio escapes the pack": escapes_root(F.col("reference_audio")),
    }
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(hit, F.lit(False)), F.lit(rule)) for rule, hit in rules.items()]))
    return df.select("id", F.explode(broken).alias("rule"))


def focus_phone(phones: Column) -> Column:
    return F.get(F.filter(phones, lambda p: F.coalesce(p["focus"], F.lit(False))), F.lit(0))


def exercise_catalog(df: DataFrame) -> DataFrame:
    """Summaries in id order, with the canonical focus phone."""
    rows = df.withColumn("focus_phone", normalize_phone(focus_phone(F.col("phones"))["ph"]))
    keep = ["id", "pack_id", "type", "title", "text", "ipa", "focus_phone"]
    return rows.select(*[c for c in keep if c in rows.columns]).orderBy("id")


def exercise_detail(df: DataFrame, media: DataFrame) -> DataFrame:
    """Full exercises with indexed phones and whether the reference recording exists."""
    phones = F.transform("phones", lambda p, i: F.struct(
        i.alias("index"), normalize_phone(p["ph"]).alias("ph"),
        F.coalesce(p["focus"], F.lit(False)).alias("focus"), p["confusions"].alias("confusions")))
    have = media.select(F.col("path").alias("_path")).distinct()
    return df.withColumn("phones", phones).join(
        have, F.col("reference_audio") == F.col("_path"), "left").withColumn(
        "has_reference_audio", F.col("_path").isNotNull()).drop("_path")


# -- PART: exercises of the test view -----------------------------------------------------

PART_SQL = """
SELECT p_partkey, p_size, p_name AS title, p_type AS text,
  CASE WHEN p_partkey % 29 = 3 THEN 'Bad Id' WHEN p_partkey % 31 = 5 THEN 'en.dup'
       ELSE concat('en.ex-', CAST(p_partkey AS STRING)) END AS id,
  CASE p_size % 5 WHEN 0 THEN 'minimal_pair' WHEN 1 THEN 'word' WHEN 2 THEN 'sentence'
       WHEN 3 THEN 'intonation' ELSE CASE WHEN p_partkey % 7 = 0 THEN 'poem' ELSE 'word' END END AS type,
  CASE WHEN p_partkey % 6 = 1 THEN concat('en.ex-', CAST(p_partkey + 40 AS STRING)) END AS pair_with,
  CASE WHEN p_partkey % 11 = 2 THEN '../other/a.wav' WHEN p_partkey % 11 = 3 THEN 'audio/../../a.wav'
       WHEN p_partkey % 11 = 4 THEN 'audio/../a.wav' WHEN p_partkey % 11 = 5 THEN NULL ELSE 'audio/a.wav' END AS reference_audio,
  CASE p_partkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_focus,
  CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE 2 END AS n_conf,
  CASE WHEN p_partkey % 17 = 4 THEN 'Q' ELSE 'ˈiː' END AS odd
FROM {part}
"""


def shaped() -> list[Column]:
    """Columns of the exercise struct from the flat view."""
    conf = F.when(F.col("n_conf") == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.lit("z"), F.lit("d")))
    none = F.array().cast("array<string>")
    phone = lambda ph, focus: F.struct(
        ph.alias("ph"), focus.alias("focus"), F.when(focus, conf).otherwise(none).alias("confusions"))
    phones = F.array(
        phone(F.lit("ð"), F.col("n_focus") >= 1), phone(F.lit("g"), F.col("n_focus") >= 2),
        phone(F.col("odd"), F.lit(False)))
    prosody = F.when(F.col("p_partkey") % 4 != 1, F.struct(
        F.lit(1).alias("nuclear_syllable_index"),
        F.when(F.col("p_partkey") % 23 == 2, "wail").otherwise("fall").alias("expected_tone")))
    return [F.col("id"), F.col("type"), F.col("title"), F.lit("en").alias("lang"), F.col("text"),
            F.lit("ðiːz").alias("ipa"), phones.alias("phones"), F.col("pair_with"),
            F.col("reference_audio"), prosody.alias("prosody")]


PART_CTE = ("WITH ex AS (SELECT *, CASE WHEN n_focus >= 1 THEN 'ð' END AS focus, "
            "CASE WHEN p_partkey % 4 <> 1 THEN CASE WHEN p_partkey % 23 = 2 THEN 'wail' ELSE 'fall' END END AS tone FROM ("
            + PART_SQL.format(part="part") + "))")
RULES_SQL = """, r AS (
  SELECT id, 'missing field' AS rule FROM ex WHERE reference_audio IS NULL
  UNION ALL SELECT id, 'bad id' FROM ex WHERE id = 'Bad Id'
  UNION ALL SELECT id, 'unknown type' FROM ex WHERE type = 'poem'
  UNION ALL SELECT id, 'unmappable phone' FROM ex WHERE odd = 'Q'
  UNION ALL SELECT id, 'needs exactly one focus phone' FROM ex WHERE type IN ('minimal_pair', 'word', 'sentence') AND n_focus <> 1
  UNION ALL SELECT id, 'focus phone needs confusions' FROM ex WHERE type IN ('minimal_pair', 'word', 'sentence') AND n_focus = 1 AND n_conf = 0
  UNION ALL SELECT id, 'intonation needs prosody' FROM ex WHERE type = 'intonation' AND tone IS NULL
  UNION ALL SELECT id, 'unknown tone' FROM ex WHERE tone = 'wail'
  UNION ALL SELECT id, 'audio escapes the pack' FROM ex WHERE reference_audio IN ('../other/a.wav', 'audio/../../a.wav'))
SELECT * FROM r"""
