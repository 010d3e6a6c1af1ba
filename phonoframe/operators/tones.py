"""Intonation exams, annotator agreement, label census and threshold grids.

Every grid search bins records by the thresholds they pass and sweeps the bins, so a
record is read once however fine the grid is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import col, count_if, ratio
from phonoframe.operators.contour import glide_extremes, nuclear_tone, slope_windows, tone_rule
from phonoframe.operators.ranks import join_keys, median_rank, positions, top_k

BINARY = ("fall", "rise")


def _bars(df: DataFrame) -> DataFrame:
    accurate = F.col("accuracy") >= K.TONE_ACCURACY_BAR
    octave = F.coalesce(F.col("mean_octave_error_rate") < K.OCTAVE_RATE_BAR, F.lit(False))
    pool = F.col("kind") == "all"
    return df.withColumns({
        "accuracy_met": F.when(pool, accurate), "octave_met": F.when(pool, octave),
        "met": F.when(pool, accurate & octave)})


def _tone_groups(rows: DataFrame, groups: list[str], tones: list[str]) -> DataFrame:
    """Counts per expected tone, per other group and overall, in one pass."""
    core, hit = F.col("expected_tone").isin(*BINARY), F.col("detected") == F.col("expected_tone")
    names = ["expected_tone", *groups]
    grouped = rows.groupingSets([[F.col(g)] for g in names] + [[]], *[F.col(g) for g in names]).agg(
        *[F.grouping(g).alias(f"_g_{g}") for g in names],
        F.count("*").alias("_n"), count_if(hit).alias("_hit"),
        count_if(core).alias("_core"), count_if(core & hit).alias("_core_hit"),
        F.avg("octave_error_rate").alias("_octave"))
    by_tone = F.col("_g_expected_tone") == 0
    kind, name = F.lit("all"), F.lit("")
    for g in groups:
        kind = F.when(F.col(f"_g_{g}") == 0, F.lit(g)).otherwise(kind)
        name = F.when(F.col(f"_g_{g}") == 0, F.col(g)).otherwise(name)
    n = F.when(by_tone, F.col("_n")).otherwise(F.col("_core"))
    hits = F.when(by_tone, F.col("_hit")).otherwise(F.col("_core_hit"))
    table = grouped.select(
        F.when(by_tone, "tone").otherwise(kind).alias("kind"),
        F.when(by_tone, F.col("expected_tone")).otherwise(name).alias("name"),
        n.alias("n"), ratio(hits, n).alias("accuracy"),
        F.round("_octave", 5).alias("mean_octave_error_rate"))
    shown = table.filter((F.col("kind") != "tone") | F.col("name").isin(*tones))
    pooled = F.when(F.col("kind") == "all", F.col("mean_octave_error_rate"))
    return _bars(shown.withColumn("mean_octave_error_rate", pooled).filter(
        (F.col("kind") == "all") | (F.col("n") > 0)))


def tone_exam(df: DataFrame, split: DataFrame) -> DataFrame:
    """Fall-versus-rise accuracy of detected test units, per tone, per annotator, overall."""
    test = split.filter(F.col("split") == "test").select("block")
    rows = df.join(test, "block", "left_semi").filter(F.col("detected").isNotNull())
    return _tone_groups(rows, ["annotator"], ["fall", "rise", "fall_rise"])


def takes_exam(df: DataFrame) -> DataFrame:
    """Accuracy of usable takes per tone and overall, with the bars."""
    return _tone_groups(df.filter(F.col("status") == "ok"), [], K.TONES)


def takes_flags(df: DataFrame) -> DataFrame:
    """Takes a human should check: not excluded, and unusable or different from expected."""
    differs = ~F.col("detected").eqNullSafe(F.col("expected_tone"))
    return df.filter((F.col("status") != "excluded") & ((F.col("status") != "ok") | differs))


def agreement(pairs: DataFrame) -> DataFrame:
    """(kind, agree, total, share) of matched pairs: per class, overall, fall vs rise, fall."""
    mine, other = F.col("expected_tone"), F.col("b_expected_tone")
    both = mine.isin(*BINARY) & other.isin(*BINARY)
    kinds = F.array_compact(F.array(
        F.concat(F.lit("class "), mine), F.lit("overall"), F.when(both, "fall vs rise"),
        F.when(mine == "fall", "fall reproduced")))
    rows = pairs.filter(other.isNotNull()).withColumn("kind", F.explode(kinds))
    return rows.groupBy("kind").agg(
        count_if(mine == other).alias("agree"), F.count("*").alias("total"),
        ratio(count_if(mine == other), F.count("*")).alias("share"))


def marks_of(text: Column | str) -> Column:
    """The tone-mark characters of a word label, in order; null when it has none."""
    pattern = "[^" + K.MARK_CHARS.replace("\\", "\\\\").replace("^", "\\^") + "]"
    kept = F.regexp_replace(col(text), pattern, "")
    return F.when((kept != "") & (col(text) != "_"), kept)


def symbol_confusion(pairs: DataFrame, mine: str, other: str, k: int = 6) -> DataFrame:
    """Most frequent marks of the second annotator for each mark of the first."""
    rows = pairs.filter(F.col(mine).isNotNull() & F.col(other).isNotNull())
    counts = rows.groupBy(mine, other).agg(F.count("*").alias("n"))
    return top_k(counts, [mine], [F.col("n").desc(), F.col(other)], k)


def char_census(df: DataFrame, text: str, drop: str | None = None) -> DataFrame:
    """Counts of every character; ``drop`` is a pattern of characters to leave out.

    Dropped characters go before the split; counts are combined on the map side.
    """
    body = F.regexp_replace(text, drop, "") if drop else F.col(text)
    chars = df.select(F.explode(F.split(body, "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n"))


def char_contexts(df: DataFrame, text: str, chars: list[str], k: int) -> DataFrame:
    """The k most frequent words holding each of the given characters."""
    words = df.select(F.explode(F.split(text, r"\s+")).alias("context"))
    held = F.filter(F.array(*[F.lit(c) for c in chars]), lambda c: F.contains(F.col("context"), c))
    counts = words.withColumn("ch", F.explode(held)).groupBy("ch", "context").agg(F.count("*").alias("n"))
    return top_k(counts, ["ch"], [F.col("n").desc(), F.col("context")], k)


def movement_dist(df: DataFrame, mark: str, movement: str, floor: float = 0.05) -> DataFrame:
    """Mark x movement counts and shares of at least ``floor``."""
    counts = df.groupBy(mark, movement).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy(mark))
    shares = counts.withColumns({"total": whole, "_share": F.col("n") / whole})
    return shares.filter(F.col("_share") >= floor).select(
        mark, movement, "n", "total", F.round("_share", 4).alias("share"))


def class_quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Index quantiles sorted[n // 4], [n // 10], [9n // 10], [3n // 4], median and minimum."""
    ranks = {
        "minimum": F.lit(0).cast("bigint"), "p10": F.expr("n div 10"), "p25": F.expr("n div 4"),
        "median": median_rank(), "p75": F.expr("3 * n div 4"), "p90": F.expr("9 * n div 10")}
    rows = positions(df, by, value, ranks)
    return rows.select(*by, "n", *[F.round(r, 4).alias(r) for r in ranks])


# -- grids ---------------------------------------------------------------------------------


def _passed(x: Column, grid: list[int]) -> Column:
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= x)), F.lit(0))


def _axis(df: DataFrame, name: str, grid: list[int]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(g).alias("v")) for i, g in enumerate(grid)])
    return df.withColumn("_x", F.explode(steps)).select(
        "*", F.col("_x.k").alias(f"_{name}_k"), F.col("_x.v").alias(name)).drop("_x")


def grid2(df: DataFrame, slope: str, lows: list[int], highs: list[int]) -> DataFrame:
    """Accuracy and coverage of every (lo, hi) pair with abstention in between."""
    s = F.col(slope)
    rows = df.filter(F.col("expected_tone").isin(*BINARY) & s.isNotNull())
    bins = rows.groupBy(
        "expected_tone", _passed(-s, lows).alias("_f"), _passed(s, highs).alias("_r")
    ).agg(F.count("*").alias("_n"))
    cells = _axis(_axis(bins, "lo", lows), "hi", highs)
    fall, rise = F.col("_lo_k") < F.col("_f"), F.col("_hi_k") < F.col("_r")
    pred = F.when(fall, "fall").when(rise, "rise")
    n = F.col("_n")
    totals = cells.groupBy("lo", "hi").agg(
        F.sum(n).alias("total"), F.sum(F.when(pred.isNotNull(), n).otherwise(0)).alias("answered"),
        F.sum(F.when(pred == F.col("expected_tone"), n).otherwise(0)).alias("correct"))
    return totals.filter("answered > 0").select(
        "lo", "hi", "answered", ratio(F.col("correct"), F.col("answered"), None).alias("accuracy"),
        ratio(F.col("answered"), F.col("total"), None).alias("coverage"))


def grid2_best(df: DataFrame, slope: str, lows: list[int], highs: list[int]) -> DataFrame:
    return grid2(df, slope, lows, highs).orderBy(F.col("accuracy").desc(), "lo", "hi").limit(1)


FALLS, RISES, HALVES = [4, 5, 6, 7, 8], [5, 6, 7, 8, 9], [10, 12, 14, 16]


def grid3(df: DataFrame, k: int = 12) -> DataFrame:
    """Best (fall, rise, half) thresholds of the tone rule; ties prefer larger thresholds.

    Needs expected_tone, slope, first_slope, second_slope of fall and rise takes.
    """
    s = F.col("slope")
    dip = F.least(-F.col("first_slope"), F.col("second_slope"))
    dip = F.when(F.col("first_slope").isNotNull() & F.col("second_slope").isNotNull(), dip)
    bins = df.groupBy(
        "expected_tone", s.isNotNull().alias("_known"), _passed(-s, FALLS).alias("_f"),
        _passed(s, RISES).alias("_r"), _passed(dip, HALVES).alias("_d"),
    ).agg(F.count("*").alias("_n"))
    cells = _axis(_axis(_axis(bins, "fall", FALLS), "rise", RISES), "half", HALVES)
    tone = (
        F.when(F.col("_half_k") < F.col("_d"), "fall_rise").when(F.col("_rise_k") < F.col("_r"), "rise")
        .when(F.col("_fall_k") < F.col("_f"), "fall").otherwise("level"))
    right = F.col("_known") & (tone == F.col("expected_tone"))
    scored = cells.groupBy("fall", "rise", "half").agg(
        ratio(F.sum(F.when(right, F.col("_n")).otherwise(0)), F.sum("_n"), None).alias("accuracy"))
    return scored.orderBy(
        F.col("accuracy").desc(), F.col("fall").desc(), F.col("rise").desc(), F.col("half").desc()).limit(k)


def grid3_misses(df: DataFrame) -> DataFrame:
    """Takes that the best rule gets wrong."""
    best = F.broadcast(grid3(df, 1).select("fall", "rise", "half"))
    rows = df.crossJoin(best)
    rule = tone_rule(F.col("slope"), F.col("first_slope"), F.col("second_slope"),
                     F.col("fall"), F.col("rise"), F.col("half"))
    got = F.when(F.col("slope").isNull(), "none").otherwise(rule["tone"])
    return rows.withColumn("detected", got).filter(F.col("detected") != F.col("expected_tone"))


GLIDES = list(range(2, 31))


def glide_sweep(df: DataFrame) -> DataFrame:
    """One threshold on the steepest glide, fit outside the test blocks.

    Needs expected_tone, s_min, s_max, split. Returns a row per pool (fit / test) and
    threshold, with ``chosen`` on the best fit threshold (lowest on ties).
    """
    low, high = F.col("s_min"), F.col("s_max")
    leads = low.isNotNull() & (high.isNull() | (F.abs(low) >= F.abs(high)))
    rows = df.filter(F.col("expected_tone").isin(*BINARY) & (low.isNotNull() | high.isNotNull()))
    pool = F.when(F.col("split") == "test", "test").otherwise("fit")
    bins = rows.groupBy(
        pool.alias("pool"), "expected_tone",
        F.when(leads, _passed(-low, GLIDES)).otherwise(0).alias("_f"), _passed(high, GLIDES).alias("_r"),
    ).agg(F.count("*").alias("_n"))
    cells = _axis(bins, "threshold", GLIDES)
    pred = F.when(F.col("_threshold_k") < F.col("_f"), "fall").when(F.col("_threshold_k") < F.col("_r"), "rise")
    n, want = F.col("_n"), F.col("expected_tone")
    count = lambda cond: F.sum(F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0))
    scored = cells.groupBy("pool", "threshold").agg(
        count(pred.isNotNull()).alias("answered"),
        ratio(count(pred == want), count(pred.isNotNull())).alias("accuracy"),
        ratio(count((pred == want) & (want == "fall")), count(pred.isNotNull() & (want == "fall"))).alias("fall_recall"),
        ratio(count((pred == want) & (want == "rise")), count(pred.isNotNull() & (want == "rise"))).alias("rise_recall"))
    best = scored.filter("pool = 'fit'").orderBy(F.col("accuracy").desc(), "threshold").limit(1).select(
        F.col("threshold").alias("_best"))
    return scored.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("threshold") == F.col("_best")).drop("_best")


def mismatch_report(df: DataFrame, expected: DataFrame, value: str = "st") -> DataFrame:
    """Takes whose detected tone differs, with every slope measurement side by side."""
    tones = nuclear_tone(df, value)
    wrong = join_keys(tones, expected.select("clip", "expected_tone"), ["clip"]).filter(
        F.col("tone") != F.col("expected_tone"))
    windows = slope_windows(df, "clip", value)
    steep = glide_extremes(df, value, least_frames=3)
    rows = join_keys(join_keys(wrong, windows, ["clip"], "left"), steep, ["clip"], "left")
    biggest = F.when(F.abs("s_min") > F.abs("s_max"), F.col("s_min")).otherwise(F.col("s_max"))
    r = lambda c: F.round(c, 4).alias(c)
    return rows.select(
        "clip", "expected_tone", "tone", r("slope"), r("first_slope"), r("second_slope"), r("whole"),
        r("terminal"), F.round(biggest, 4).alias("steepest"), "n")
