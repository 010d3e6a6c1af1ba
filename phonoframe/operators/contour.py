"""Pitch contours as frame rows (clip, i, t, value): cleaning, slopes, tones, distance.

Neighbourhood operators run on chunks of a clip with copied edge frames, so one very
long clip is processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.functions.scalar import col, let, to_semitones
from phonoframe.functions.warp import dtw_distance  # noqa: F401
from phonoframe.operators.ranks import (
    chunked,
    join_keys,
    median_rank,
    own_rows,
    percentile_rank,
    positions,
    row_index,
    running,
)

TERMINAL_S, RISE_BAR, FALL_BAR, HALF_BAR = 0.35, 6.0, 4.0, 12.0
OCTAVE_JUMP = 9.0
TINY = 1e-6
CHUNK_S = 41.0


def _semitone_gap(hz: Column, local: Column) -> Column:
    return F.abs(F.lit(12.0) * F.log2(hz / local))


def _median_of(values: Column) -> Column:
    """Median of the non-null entries of a short array."""
    def middle(known: Column) -> Column:
        n = F.size(known)
        pick = lambda k: F.get(known, F.floor(k / 2).cast("int"))
        return F.when(n > 0, (pick(n - 1) + pick(n)) / 2.0)

    return let(F.array_sort(F.array_compact(values)), middle)


def rolling_median(df: DataFrame, value: str = "hz", width: int = 7, name: str = "local") -> DataFrame:
    """Centred median over ``width`` frames, nulls ignored, edge frames repeated outwards.

    Frames are contiguous, so a window that is short on one side touches the end of the
    clip and its outermost frame fills the missing places.
    """
    half = width // 2
    w = W.partitionBy("clip", "_chunk").orderBy("i").rowsBetween(-half, half)
    near = F.collect_list(F.struct("i", F.col(value).alias("v"))).over(w)
    rows = own_rows(chunked(df, "i", half).withColumn("_near", near))
    found = F.col("_near")
    edge = lambda k, side: F.array_repeat(
        F.get(found, k)["v"], F.lit(half) - F.size(F.filter(found, side)))
    padded = F.concat(
        edge(F.lit(0), lambda p: p["i"] < F.col("i")), F.transform(found, lambda p: p["v"]),
        edge(F.size(found) - 1, lambda p: p["i"] > F.col("i")))
    return rows.withColumn(name, _median_of(padded)).drop("_near")


def fix_octaves(df: DataFrame, value: str = "hz") -> DataFrame:
    """Rescue frames an octave off their neighbourhood, unvoice what cannot be rescued.

    Adds ``clean`` and ``touched``. Doubling is tried first, then halving, against a
    local median that stays fixed. Clips with fewer than three voiced frames stay as
    they are.
    """
    voiced = df.withColumn(value, F.when(F.col(value) > 0, F.col(value)))
    enough = voiced.groupBy("clip").agg((F.count(value) >= 3).alias("_enough"))
    rows = join_keys(rolling_median(voiced, value), enough, ["clip"])
    off = lambda hz: _semitone_gap(hz, F.col("local"))
    stages = rows.withColumn("_a", F.col(value))
    rescued = []
    for n, factor in enumerate((2.0, 0.5)):
        now = F.col("_a") if n == 0 else F.col("_b")
        saved = F.coalesce((off(now) > OCTAVE_JUMP) & (off(now * factor) < OCTAVE_JUMP), F.lit(False))
        out = "_b" if n == 0 else "_c"
        stages = stages.withColumns({out: F.when(saved, now * factor).otherwise(now), f"_s{n}": saved})
        rescued.append(F.col(f"_s{n}").cast("int"))
    lost = F.coalesce(off(F.col("_c")) > OCTAVE_JUMP, F.lit(False))
    clean = F.when(~F.col("_enough"), F.col(value)).when(~lost, F.col("_c"))
    touched = F.when(F.col("_enough"), rescued[0] + rescued[1] + lost.cast("int")).otherwise(0)
    return stages.withColumns({"clean": clean, "touched": touched}).drop(
        "_a", "_b", "_c", "_s0", "_s1", "_enough")


def track_summary(df: DataFrame, value: str = "clean", touched: str = "touched") -> DataFrame:
    """Per clip: frames, voiced share, median Hz, octave errors per voiced frame."""
    stats = df.groupBy("clip").agg(
        F.count("*").alias("frames"), F.count(value).alias("voiced"), F.sum(touched).alias("_touched"))
    mid = positions(df, ["clip"], value, {"_median": median_rank()}).drop("n")
    rows = join_keys(stats, mid, ["clip"], "left")
    usable = F.col("voiced") >= 3
    return rows.select(
        "clip", "frames", "voiced",
        F.round(F.col("voiced") / F.col("frames"), 4).alias("voiced_fraction"),
        F.when(usable, F.round("_median", 2)).alias("median_hz"),
        F.when(usable, F.round(F.col("_touched") / F.col("voiced"), 4)).alias("octave_error_rate"))


def semitone_frames(df: DataFrame, value: str = "clean") -> DataFrame:
    """Frames in semitones relative to the clip's exact median, three decimals."""
    mid = positions(df, ["clip"], value, {"_median": median_rank()}).select("clip", "_median")
    return join_keys(df, mid, ["clip"], "left").withColumn(
        "st", F.round(to_semitones(value, "_median"), 3)).drop("_median")


def pitch_range(df: DataFrame, value: str = "hz") -> DataFrame:
    """Search range of a speaker from the 5th and 95th percentile of voiced frames."""
    ps = positions(df, ["clip"], value, {"_p5": percentile_rank(5), "_p95": percentile_rank(95)})
    floor = F.least(F.greatest(0.75 * F.col("_p5"), F.lit(50.0)), F.lit(899.0))
    rows = ps.withColumn("floor_hz", floor)
    ceiling = F.least(F.greatest(1.5 * F.col("_p95"), F.col("floor_hz") + 50.0), F.lit(900.0))
    return rows.select("clip", "floor_hz", ceiling.alias("ceiling_hz"))


def voiced(df: DataFrame, start: Column | float, end: Column | float, value: str = "st") -> DataFrame:
    """Voiced frames inside [start, end], a microsecond of slack on both sides."""
    s = F.lit(start) if isinstance(start, float) else start
    e = F.lit(end) if isinstance(end, float) else end
    return df.filter(F.col(value).isNotNull() & F.col("t").between(s - TINY, e + TINY))


def _slope_of(value: Column, t: Column, keep: Column | None = None) -> Column:
    """Least-squares slope aggregate, null under three points or without time spread."""
    ok = value.isNotNull() if keep is None else value.isNotNull() & keep
    y, x = F.when(ok, value), F.when(ok, t)
    enough = (F.count(y) >= 3) & (F.max(x) - F.min(x) >= 1e-3)
    return F.when(enough, F.regr_slope(y, x))


def ols_slope(df: DataFrame, by: list[str], value: str = "st") -> DataFrame:
    return df.groupBy(*by).agg(_slope_of(F.col(value), F.col("t")).alias("slope"))


def slope_windows(df: DataFrame, by: str = "clip", value: str = "st") -> DataFrame:
    """Whole, last 0.35 s and first 0.30 s slopes side by side."""
    span = df.groupBy(by).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    rows = join_keys(df.filter(F.col(value).isNotNull()), span, [by])
    v, t = F.col(value), F.col("t")
    return rows.groupBy(by).agg(
        _slope_of(v, t).alias("whole"),
        _slope_of(v, t, t >= F.col("_t1") - TERMINAL_S).alias("terminal"),
        _slope_of(v, t, t <= F.col("_t0") + 0.3).alias("first03"))


# -- robust slopes on bounded windows ----------------------------------------------------


def theil_sen(points: Column) -> Column:
    """Median of pairwise slopes of array<struct<t, v>>, null under three points.

    The array is one analysis window (0.35 s, about 36 frames), so the pairs stay inside
    one row and are bounded by the window, not by the clip.
    """
    pairs = lambda pts: F.flatten(F.transform(pts, lambda p, i: F.transform(
        F.filter(F.slice(pts, i + 2, F.size(pts)), lambda q: q["t"] - p["t"] > TINY),
        lambda q: (q["v"] - p["v"]) / (q["t"] - p["t"]))))
    times = lambda pts: F.transform(pts, lambda p: p["t"])
    wide = lambda ts: F.array_max(ts) - F.array_min(ts) >= 1e-3
    return let(points, lambda pts: F.when(
        (F.size(pts) >= 3) & let(times(pts), wide), _median_of(pairs(pts))))


def terminal_points(df: DataFrame, value: str = "st", end: DataFrame | None = None) -> DataFrame:
    """Per clip the voiced points of the last 0.35 s up to the last voiced frame.

    Frames are packed into cells of one window length that also carry the cell before.
    The last cell with a voiced frame then holds the whole window: one pass, and no task
    ever sees more of a clip than two cells per candidate.
    """
    rows = df.select("clip", "t", F.col(value).alias("v"))
    if end is not None:
        limited = join_keys(rows, end.select("clip", "end_s"), ["clip"], "left")
        late = F.coalesce(F.col("t") > F.col("end_s") + TINY, F.lit(False))
        rows = limited.select("clip", "t", F.when(~late, F.col("v")).alias("v"))
    home = F.floor(F.col("t") / F.lit(TERMINAL_S))
    spread = rows.withColumn("_home", home).withColumn(
        "_cell", F.explode(F.when(F.col("v").isNotNull(), F.array("_home", F.col("_home") + 1)).otherwise(
            F.array("_home"))))
    said = F.col("v").isNotNull()
    cells = spread.groupBy("clip", "_cell").agg(
        F.max(F.when(said & (F.col("_home") == F.col("_cell")), F.col("t"))).alias("_last"),
        F.collect_list(F.when(said, F.struct("t", "v"))).alias("_points"))
    best = cells.groupBy("clip").agg(F.max_by(
        F.struct("_last", "_points"), F.when(F.col("_last").isNotNull(), F.col("_cell"))).alias("_b"))
    start = F.greatest(F.lit(0.0), F.col("_b._last") - TERMINAL_S)
    inside = F.filter("_b._points", lambda p: p["t"].between(start - TINY, F.col("_b._last") + TINY))
    return best.select("clip", F.coalesce(
        F.array_sort(inside), F.array().cast("array<struct<t:double,v:double>>")).alias("points"))


def halves(points: Column) -> tuple[Column, Column]:
    t = lambda k: F.get(points, k)["t"]
    mid = t(F.lit(0)) + (t(F.size(points) - 1) - t(F.lit(0))) / 2.0
    half = lambda keep: let(mid, lambda m: F.filter(points, lambda p: keep(p["t"], m)))
    return half(lambda t, m: t <= m), half(lambda t, m: t > m)


def terminal_slopes(df: DataFrame, value: str = "st", end: DataFrame | None = None) -> DataFrame:
    """Robust slopes of the terminal window and of its two halves."""
    rows = terminal_points(df, value, end)
    first, second = halves(F.col("points"))
    return rows.withColumns({"_first": first, "_second": second}).select(
        "clip", F.size("points").alias("n"), theil_sen(F.col("points")).alias("slope"),
        theil_sen(F.col("_first")).alias("first_slope"), theil_sen(F.col("_second")).alias("second_slope"))


def tone_rule(
    slope: Column, first: Column, second: Column, fall: float = FALL_BAR, rise: float = RISE_BAR,
    half: float = HALF_BAR,
) -> Column:
    """struct(tone, confidence) from the terminal slopes."""
    dip = F.coalesce((first <= -half) & (second >= half), F.lit(False))
    tone = (
        F.when(slope.isNull(), "level").when(dip, "fall_rise").when(slope >= rise, "rise")
        .when(slope <= -fall, "fall").otherwise("level"))
    sure = F.when(slope.isNull(), 0.0).when(dip, 1.0).otherwise(
        F.least(F.lit(1.0), F.abs(slope) / (2 * RISE_BAR)))
    return F.struct(tone.alias("tone"), sure.alias("confidence"))


def nuclear_tone(df: DataFrame, value: str = "st", end: DataFrame | None = None) -> DataFrame:
    """Tone and confidence of each clip from its terminal voiced movement."""
    rows = terminal_slopes(df, value, end)
    return rows.withColumn(
        "_t", tone_rule(F.col("slope"), F.col("first_slope"), F.col("second_slope"))
    ).select("clip", "n", "slope", "first_slope", "second_slope", "_t.tone", "_t.confidence")


# -- runs, smoothing, steepest glides ----------------------------------------------------


def voiced_runs(df: DataFrame, value: str = "st", gap: float = 0.04, hop: float = 0.01) -> DataFrame:
    """Voiced frames with ``run``: a new run starts after more than ``gap`` plus a hop.

    Clips are chunked by time, so any spacing of frames gives the same runs.
    """
    said = df.filter(F.col(value).isNotNull())
    reach = gap + hop
    prior = F.lag("t").over(W.partitionBy("clip", "_chunk").orderBy("i"))
    flagged = own_rows(chunked(said, "t", reach + TINY, CHUNK_S).withColumn("_prior", prior))
    starts = F.coalesce(F.col("t") - F.col("_prior") > reach, F.lit(True)).cast("bigint")
    return running(
        flagged, ["clip"], ["i"], {"run": starts}, F.expr("i div 4096")).drop("_prior")


def median_smooth(df: DataFrame, value: str = "st", width: int = 5, name: str = "smooth") -> DataFrame:
    """Median over neighbouring voiced frames, the window cut at the ends of the clip."""
    half = width // 2
    said = row_index(df.filter(F.col(value).isNotNull()), ["clip"], ["i"], F.expr("i div 4096"), "_n", sparse=True)
    w = W.partitionBy("clip", "_chunk").orderBy("_n").rowsBetween(-half, half)
    windowed = chunked(said, "_n", half).withColumn(name, F.percentile(F.col(value), F.lit(0.5)).over(w))
    return own_rows(windowed).drop("_n")


def _steepest(span: float, least_points: int):
    """Per row of sorted (clip, chunk, own, t, v, run): own rows with the extreme slopes of windows that start there.

    All starts move on together: a step adds to each the next row of its chunk and run, while it is near enough.
    """

    def slopes(group: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(len(t), np.inf), np.full(len(t), -np.inf)
        at = np.arange(len(t))
        n, sx, sy, sxy, sxx = np.zeros((5, len(t)))
        step = 0
        while len(at):
            x, y = t[at + step] - t[at], v[at + step]
            n[at], sx[at], sy[at], sxy[at], sxx[at] = n[at] + 1.0, sx[at] + x, sy[at] + y, sxy[at] + x * y, sxx[at] + x * x
            spread = n[at] * sxx[at] - sx[at] * sx[at]
            full = at[(n[at] >= least_points) & (spread > 0)]
            slope = (n[full] * sxy[full] - sx[full] * sy[full]) / (n[full] * sxx[full] - sx[full] * sx[full])
            low[full], high[full] = np.minimum(low[full], slope), np.maximum(high[full], slope)
            step += 1
            at = at[at + step < len(t)]
            at = at[(group[at + step] == group[at]) & (t[at + step] - t[at] <= span + TINY)]
        return low, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved(rows: pa.Table) -> pa.RecordBatch:
            clip, chunk, track = (pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in (
                "clip", "_chunk", "run"))
            fresh = np.ones(len(clip), bool)
            fresh[1:] = (clip[1:] != clip[:-1]) | (chunk[1:] != chunk[:-1]) | (track[1:] != track[:-1])
            low, high = slopes(np.cumsum(fresh), rows["t"].to_numpy(), rows["v"].to_numpy())
            own = rows["_own"].combine_chunks()
            out = pa.table({
                "clip": rows["clip"], "t": rows["t"], "low": pa.array(low, mask=np.isinf(low)),
                "high": pa.array(high, mask=np.isinf(high))}).filter(own)
            return out.combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            key = [(b.column(0)[k].as_py(), b.column(1)[k].as_py()) for b, k in ((held[0], 0), (batch, batch.num_rows - 1))]
            if key[0] == key[1]:
                continue
            # the last chunk may go on in the next batch
            rows = pa.Table.from_batches(held).combine_chunks()
            clip, chunk = (pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in ("clip", "_chunk"))
            cut = int(np.flatnonzero((clip[1:] != clip[:-1]) | (chunk[1:] != chunk[:-1]))[-1]) + 1
            yield from solved(rows.slice(0, cut)).to_batches()
            held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def glide_windows(
    df: DataFrame, value: str, span: float = 0.25, least_points: int = 4, run: str | None = None,
) -> DataFrame:
    """Per voiced frame the flattest-to-steepest slopes of windows that start there.

    A window ends on a later frame of the same ``run`` no more than ``span`` away. Frames are dealt by chunk of a
    clip, with those in reach of its end, and sums grow over the frames ahead; no frame is copied for each
    window and no pair of frames becomes a row.
    """
    said = df.filter(F.col(value).isNotNull())
    track = F.col(run).cast("bigint") if run else F.lit(0).cast("bigint")
    dealt = chunked(said, "t", span + TINY, CHUNK_S).select(
        "clip", "_chunk", "_own", F.col("t").cast("double").alias("t"), F.col(value).cast("double").alias("v"), track.alias("run"),
    ).repartition("clip", "_chunk").sortWithinPartitions("clip", "_chunk", "t")
    schema = T.StructType([
        T.StructField("clip", df.schema["clip"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("t", "low", "high")]])
    return dealt.mapInArrow(_steepest(span, least_points), schema)


def glide_extremes(
    df: DataFrame, value: str = "st", span: float = 0.25, least_points: int = 4,
    run: str | None = None, least_frames: int = 6,
) -> DataFrame:
    """Steepest falling and rising sub-window slopes of each clip, with their start times."""
    rows = glide_windows(df, value, span, least_points, run)
    best = rows.groupBy("clip").agg(
        F.count("*").alias("_frames"),
        F.min("low").alias("s_min"), F.min_by("t", F.struct(F.coalesce("low", F.lit(float("inf"))), "t")).alias("t_min"),
        F.max("high").alias("s_max"), F.min_by("t", F.struct(-F.coalesce("high", F.lit(float("-inf"))), F.col("t"))).alias("t_max"))
    return best.filter(F.col("_frames") >= least_frames).select(
        "clip", "s_min", F.when(F.col("s_min").isNotNull(), F.col("t_min")).alias("t_min"),
        "s_max", F.when(F.col("s_max").isNotNull(), F.col("t_max")).alias("t_max"))


# -- contour distance ------------------------------------------------------------------------


def contour_match(distance: Column | str, scale: float = 4.0) -> Column:
    return F.exp(-F.sqrt(col(distance)) / scale)


# -- speech interval -----------------------------------------------------------------------


def speech_interval(
    df: DataFrame, value: str = "db", hop: float = 0.010, frame: float = 0.025, pad: float = 0.08,
    shortest: float = 0.08, duration: DataFrame | None = None,
) -> DataFrame:
    """Energy detector with hysteresis over frame rows (clip, i, db).

    Core frames locate speech, the first and last core frame grow outwards through
    frames above the edge threshold. Grown edges come from the nearest quiet frame on
    either side, so no frame list is ever collected.
    """
    p = positions(df, ["clip"], value, {"_floor": percentile_rank(5), "_peak": percentile_rank(95)})
    rng = F.col("_peak") - F.col("_floor")
    gates = p.select(
        "clip", F.round(rng, 1).alias("snr_db"), (rng >= 6.0).alias("_spread"),
        (F.col("_floor") + F.greatest(0.45 * rng, F.lit(8.0))).alias("_core"),
        (F.col("_floor") + F.greatest(0.15 * rng, F.lit(3.0))).alias("_edge"))
    rows = join_keys(df, gates, ["clip"])
    core = F.when(F.col(value) > F.col("_core"), F.col("i"))
    spans = rows.groupBy("clip").agg(
        F.min(core).alias("_first"), F.max(core).alias("_last"), F.min("i").alias("_low"),
        F.max("i").alias("_high"), F.first("snr_db").alias("snr_db"), F.first("_spread").alias("_spread"))
    quiet = rows.filter(F.col(value) <= F.col("_edge")).select("clip", "i")
    around = join_keys(quiet, spans.select("clip", "_first", "_last"), ["clip"]).groupBy("clip").agg(
        F.max(F.when(F.col("i") < F.col("_first"), F.col("i"))).alias("_before"),
        F.min(F.when(F.col("i") > F.col("_last"), F.col("i"))).alias("_after"))
    grown = join_keys(spans, around, ["clip"], "left")
    if duration is not None:
        grown = join_keys(grown, duration.select("clip", "duration_s"), ["clip"])
    else:
        grown = grown.withColumn("duration_s", (F.col("_high") + 1) * hop)
    first = F.coalesce(F.col("_before") + 1, F.col("_low"))
    last = F.coalesce(F.col("_after") - 1, F.col("_high"))
    start = F.greatest(F.lit(0.0), first * hop - pad)
    end = F.least(F.col("duration_s"), last * hop + frame + pad)
    found = F.col("_spread") & F.col("_first").isNotNull() & (end - start >= shortest)
    return grown.select(
        "clip", F.when(found, F.round(start, 4)).alias("start_s"),
        F.when(found, F.round(end, 4)).alias("end_s"), "snr_db")


