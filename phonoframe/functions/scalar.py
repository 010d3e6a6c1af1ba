"""Scalar column expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from phonoframe import tables as K


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(value: Column | str | float) -> Column:
    """A number as a literal, a name or an expression as a column."""
    return F.lit(float(value)) if isinstance(value, (int, float)) else col(value)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(part) for item in mapping.items() for part in item])


def lookup(mapping: dict, key: Column) -> Column:
    """Value of ``key`` in a constant table; null when it is absent."""
    return F.try_element_at(literal_map(mapping), key)


def isin(key: Column, values: list[str]) -> Column:
    return key.isin(*values)


def ratio(top: Column, bottom: Column, digits: int | None = 4) -> Column:
    """top / bottom, 0 on an empty denominator, rounded half-up."""
    share = F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))
    return share if digits is None else F.round(share, digits)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Stable bucket of a string key from the first 32 bits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible shuffle key: md5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


# -- label functions ------------------------------------------------------------


def normalize_phone(c: Column | str) -> Column:
    """Canonical phone of an authored label, null when it has none."""
    bare = F.translate(F.trim(col(c)), K.STRIPPED_MARKS, "")
    table = {**K.ALIASES, **{phone: phone for phone in K.CANONICAL}}
    return lookup(table, bare)


def arpabet(c: Column | str) -> Column:
    """Canonical phone of an ARPABET label, stress removed; null when it has none."""
    clean = F.trim(col(c))
    base = F.regexp_replace(clean, "[012*]$", "")
    return F.when(~isin(clean, K.ARPABET_SILENCE), lookup(K.ARPABET, base))


def is_tier_silence(c: Column) -> Column:
    return (c == "") | isin(F.lower(c), K.TIER_SILENCE)


def clean_tier_label(c: Column | str) -> Column:
    """Annotation label with its junk tail removed, never shorter than one character."""
    trimmed = F.trim(col(c))
    return F.regexp_replace(trimmed, f"(?<=.)[{K.JUNK_TAIL}]+$", "")


def tier_phone(c: Column | str) -> Column:
    """Canonical phone of a hand-annotated label; null for silence and for unmappable."""
    def mapped(clean: Column) -> Column:
        base = F.when(clean.startswith("R"), F.lit("R")).otherwise(clean)
        phone = let(base, lambda b: F.coalesce(
            arpabet(b),
            arpabet(F.upper(b)),
            normalize_phone(b),
            F.when(b == "ɫ", F.lit("l")),
        ))
        return F.when(~is_tier_silence(clean), phone)

    # every branch asks for the cleaned label, so it is worked out once
    return F.when(~is_tier_silence(F.trim(col(c))), let(clean_tier_label(c), mapped))


def tone_mark(c: Column | str) -> Column:
    """struct(tone, text) of a word label with tonetic stress marks."""
    bare = F.regexp_replace(col(c), "^[<>]+", "")
    longest_first = sorted(K.TONE_MARKS, key=len, reverse=True)
    pattern = "^(" + "|".join(p.replace("\\", "\\\\") for p in longest_first) + ")"
    mark = F.regexp_extract(bare, pattern, 1)
    rest = F.substr(bare, F.length(mark) + 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(rest, r"[|#]", ""), r"^[, ]+|[, ]+$", ""))
    return F.struct(lookup(K.TONE_MARKS, mark).alias("tone"), text.alias("text"))


def parse_contrast(c: Column | str) -> Column:
    """'target:a,b' -> struct(target, confusions); raises when there is no colon."""
    spec = col(c)
    parts = F.split(spec, ":", 2)
    names = F.filter(
        F.transform(F.split(F.get(parts, F.lit(1)), ","), lambda s: F.trim(s)), lambda name: name != ""
    )
    ok = F.struct(F.trim(F.get(parts, F.lit(0))).alias("target"), names.alias("confusions"))
    fail = F.raise_error(F.concat(F.lit("contrast needs target:confusions, got "), spec))
    return F.when(spec.contains(":"), ok).otherwise(fail.cast(
        "struct<target:string,confusions:array<string>>"))


def raw_score(posteriors: Column | str, target: Column | str) -> Column:
    """struct(score, best): log ratio of the best confusion over the target of a map."""
    post, tgt = col(posteriors), col(target) if isinstance(target, Column) else F.lit(target)
    rivals = F.map_entries(F.map_filter(post, lambda k, v: k != tgt))
    top = F.array_max(F.transform(rivals, lambda e: e["value"]))
    best = F.get(F.filter(rivals, lambda e: e["value"] == top), F.lit(0))
    p_target = F.coalesce(F.try_element_at(post, tgt), F.lit(K.EPS))
    score = F.ln((best["value"] + K.EPS) / (p_target + K.EPS))
    return F.struct(
        F.coalesce(score, F.lit(0.0)).alias("score"), best["key"].alias("best")
    )


def client_split(c: Column | str) -> Column:
    """Speaker-disjoint split: five of a hundred md5 buckets are validation."""
    return F.when(hash_bucket(col(c)) < 5, F.lit("val")).otherwise(F.lit("train"))


def to_semitones(hz: Column | str, median: Column | str) -> Column:
    return F.lit(12.0) * F.log2(F.greatest(col(hz), F.lit(1e-6)) / col(median))


# -- array helpers -----------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Bind an expression once: lambdas re-evaluate what they capture for every element,
    so anything dearer than a column reference is passed in as a bound variable."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values).cast("double"))


def zscore(c: Column | str) -> Column:
    """Array shifted to mean 0 and scaled by sqrt(population variance + 1e-7)."""
    xs = col(c)

    def scaled(mu: Column) -> Column:
        spread = mean(F.transform(xs, lambda x: F.pow(x.cast("double") - mu, F.lit(2.0))))
        return let(F.sqrt(spread + F.lit(1e-7)), lambda s: F.transform(
            xs, lambda x: (x.cast("double") - mu) / s))

    return let(mean(xs), scaled)


def first_argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return F.array_position(values, F.array_max(values)) - F.lit(1)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


# -- SQL surface -------------------------------------------------------------------


def register_functions(spark: SparkSession) -> list[str]:
    """Register the scalar surface for ``spark.sql``; Catalyst inlines every body."""
    from phonoframe.functions.spectral import spectral_features

    marks = K.STRIPPED_MARKS
    table = {**K.ALIASES, **{phone: phone for phone in K.CANONICAL}}
    entries = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    bodies = {
        "normalize_phone(label STRING) RETURNS STRING":
            f"try_element_at(map({entries}), translate(trim(label), '{marks}', ''))",
        "platt_prob(x DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE":
            "1D / (1D + exp(-(a * x + b)))",
        "client_split(client STRING) RETURNS STRING":
            "CASE WHEN CAST(conv(substring(md5(client), 1, 8), 16, 10) AS BIGINT) % 100 < 5 "
            "THEN 'val' ELSE 'train' END",
        "contrast_target(spec STRING) RETURNS STRING":
            "CASE WHEN contains(spec, ':') THEN trim(split(spec, ':', 2)[0]) "
            "WHEN spec IS NOT NULL THEN CAST(raise_error('a contrast needs a colon') AS STRING) END",
        "contrast_confusions(spec STRING) RETURNS ARRAY<STRING>":
            "CASE WHEN contains(spec, ':') THEN "
            "filter(transform(split(get(split(spec, ':', 2), 1), ','), x -> trim(x)), x -> x <> '') "
            "WHEN spec IS NOT NULL THEN CAST(raise_error('a contrast needs a colon') AS ARRAY<STRING>) END",
        "tone_of(label STRING) RETURNS STRING":
            "CASE WHEN regexp_replace(label, r'^[<>]+', '') LIKE '`/%' THEN 'fall_rise' "
            "WHEN left(regexp_replace(label, r'^[<>]+', ''), 1) IN (r'\\', '`') THEN 'fall' "
            "WHEN left(regexp_replace(label, r'^[<>]+', ''), 1) = '/' THEN 'rise' "
            "WHEN left(regexp_replace(label, r'^[<>]+', ''), 1) = '=' THEN 'level' END",
        "raw_contrast(post MAP<STRING, DOUBLE>, target STRING) RETURNS DOUBLE":
            "coalesce(ln((array_max(map_values(map_filter(post, (k, v) -> k <> target))) + 1e-12) "
            "/ (coalesce(try_element_at(post, target), 1e-12) + 1e-12)), 0D)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("spectral_features", spectral_features)
    return [head.split("(")[0] for head in bodies] + ["spectral_features"]
