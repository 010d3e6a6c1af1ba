"""Interval joins and intonation units. Range joins carry an equality on a time bucket,
so they run as hash or sort-merge joins and a long passage is spread over its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions.scalar import col, tone_mark
from phonoframe.operators.ranks import running


def _cell(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width)))


def _cells(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(_cell(low, width), _cell(F.greatest(low, high), width)))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float = 10.0) -> DataFrame:
    """Pairs of intervals of one key that overlap, with the covered share of the left one.

    Both sides have xmin and xmax; right columns come out with an ``r_`` prefix. A pair
    that shares several cells is kept only in the cell where its overlap begins.
    """
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    lc = left.withColumn("_cell", _cells(F.col("xmin"), F.col("xmax"), width))
    rc = r.withColumn("_rcell", _cells(F.col("r_xmin"), F.col("r_xmax"), width))
    start = F.greatest("xmin", "r_xmin")
    on = (
        (F.col(key) == F.col(f"r_{key}")) & (F.col("_cell") == F.col("_rcell"))
        & (F.col("r_xmax") > F.col("xmin")) & (F.col("r_xmin") < F.col("xmax"))
        & (F.col("_cell") == _cell(start, width))
    )
    shared = F.greatest(F.lit(0.0), F.least("xmax", "r_xmax") - start)
    share = shared / F.greatest(F.lit(1e-9), F.col("xmax") - F.col("xmin"))
    return lc.join(rc, on).withColumn("overlap", share).drop("_cell", "_rcell", f"r_{key}")


def point_in_interval(
    points: DataFrame, intervals: DataFrame, key: str, ids: list[str], tol: float = 0.01,
    width: float = 10.0,
) -> DataFrame:
    """First interval (lowest idx) holding each point t within a tolerance.

    Unmatched points stay, with null interval columns. ``ids`` identify a point.
    """
    cells = intervals.select(
        F.col(key).alias("_k"), "idx", F.col("xmin").alias("unit_start"), F.col("xmax").alias("unit_end"),
        _cells(F.col("xmin") - tol, F.col("xmax") + tol, width).alias("_rcell"))
    on = (
        (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_rcell"))
        & (F.col("unit_start") - tol <= F.col("t")) & (F.col("t") <= F.col("unit_end") + tol)
    )
    joined = points.withColumn("_cell", _cell(F.col("t"), width)).join(cells, on, "left")
    rest = [c for c in points.columns if c not in ids]
    hit = F.struct("idx", "unit_start", "unit_end")
    grouped = joined.groupBy(*ids).agg(
        *[F.first(c).alias(c) for c in rest], F.min_by(hit, F.col("idx")).alias("_h"))
    return grouped.select(*ids, *rest, "_h.*")


def tolerance_match(
    a: DataFrame, b: DataFrame, key: str, ids: list[str], payload: list[str], order: str,
    tol: float = 0.3, both_edges: bool = False,
) -> DataFrame:
    """First row of ``b`` (by ``order``) that starts within ``tol`` of each row of ``a``.

    With ``both_edges`` the ends must be close too. Payload columns come out with a
    ``b_`` prefix and are null without a match. Rows of b with equal times collapse to
    the first before the join, so a crowded passage cannot multiply.
    """
    edges = ["start_s", "end_s"] if both_edges else ["start_s"]
    slots = b.groupBy(key, *edges).agg(
        F.min(order).alias("_order"), *[F.min_by(p, order).alias(f"b_{p}") for p in payload])
    near = slots.withColumnsRenamed({e: f"_b_{e}" for e in edges}).withColumnRenamed(key, "_k").withColumn(
        "_rcell", F.explode(F.sequence(_cell(F.col("_b_start_s"), tol) - 1, _cell(F.col("_b_start_s"), tol) + 1)))
    close = [F.abs(F.col(f"_b_{e}") - F.col(e)) < tol for e in edges]
    on = (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_rcell"))
    for c in close:
        on = on & c
    joined = a.withColumn("_cell", _cell(F.col("start_s"), tol)).join(near, on, "left")
    rest = [c for c in a.columns if c not in ids]
    hit = F.struct(*[f"b_{p}" for p in payload])
    grouped = joined.groupBy(*ids).agg(
        *[F.first(c).alias(c) for c in rest], F.min_by(hit, F.col("_order")).alias("_h"))
    return grouped.select(*ids, *rest, "_h.*")


def gather_points(
    words: DataFrame, points: DataFrame, key: str, ids: list[str], before: float, after: float,
    width: float = 10.0,
) -> DataFrame:
    """Time-ordered points of each word's window [x1 - before, max(unit_end, x2) + after].

    ``points`` has t and v. A window is a few seconds long, so its array is bounded.
    """
    low = F.col("x1") - before
    high = F.greatest("unit_end", "x2") + after
    w = words.withColumns({"_low": low, "_high": high}).withColumn(
        "_cell", _cells(F.col("_low"), F.col("_high"), width))
    p = points.select(F.col(key).alias("_k"), "t", "v").withColumn("_rcell", _cell(F.col("t"), width))
    on = (
        (F.col(key) == F.col("_k")) & (F.col("_cell") == F.col("_rcell"))
        & F.col("t").between(F.col("_low"), F.col("_high"))
    )
    joined = w.join(p, on)
    rest = [c for c in words.columns if c not in ids]
    return joined.groupBy(*ids).agg(
        *[F.first(c).alias(c) for c in rest],
        F.sort_array(F.collect_list(F.struct("t", "v"))).alias("points"))


# -- movements over gathered points ------------------------------------------------------


def _ends(points: Column) -> tuple[Column, Column]:
    return F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)


def code_movement(points: Column | str) -> Column:
    """UP / DOWN / FLAT from the rank of the first and last known level code."""
    table = F.create_map(*[F.lit(x) for item in K.LEVEL_CODES.items() for x in item])
    known = F.filter(col(points), lambda p: F.map_contains_key(table, p["v"]))
    first, last = _ends(known)
    step = F.try_element_at(table, last["v"]) - F.try_element_at(table, first["v"])
    move = F.when(step >= 1, "UP").when(step <= -1, "DOWN").otherwise("FLAT")
    return F.when((F.size(col(points)) >= 2) & (F.size(known) >= 2), move)


def excursion(points: Column | str, bar: float = 4.0) -> Column:
    """struct(semitones, slope, movement) between the first and last pitch target."""
    pts = col(points)
    first, last = _ends(pts)
    ok = (F.size(pts) >= 2) & (first["v"] > 0) & (last["v"] > 0)
    st = F.when(ok, 12.0 * F.log2(last["v"] / first["v"]))
    slope = st / F.greatest(last["t"] - first["t"], F.lit(0.001))
    move = F.when(slope <= -bar, "FALL").when(slope >= bar, "RISE").when(slope.isNotNull(), "FLAT")
    return F.struct(st.alias("semitones"), slope.alias("slope"), move.alias("movement"))


def glide(points: Column, low: Column, high: Column, bar: float = 3.0) -> Column:
    """fall / rise / flat between the first and last target inside [low, high]."""
    inside = F.filter(points, lambda p: p["t"].between(low, high))
    first, last = _ends(inside)
    ok = (F.size(inside) >= 2) & (first["v"] > 0) & (last["v"] > 0)
    st = F.when(ok, 12.0 * F.log2(last["v"] / first["v"]))
    return F.when(st <= -bar, "fall").when(st >= bar, "rise").when(st.isNotNull(), "flat")


def glide_shape(points: Column, x1: Column, x2: Column, unit_end: Column) -> Column:
    """'<word>/<tail>' movement of a marked word and of what follows it; null without both."""
    word = glide(points, x1 - 0.02, x2 + 0.05)
    tail = glide(points, x2, unit_end + 0.05)
    known = word.isNotNull() | tail.isNotNull()
    return F.when(known, F.concat_ws("/", F.coalesce(word, F.lit("-")), F.coalesce(tail, F.lit("-"))))


# -- intonation units ------------------------------------------------------------------


def intonation_units(words: DataFrame, min_length: float = 0.4, hot: DataFrame | None = None) -> DataFrame:
    """Word intervals -> units: a word with ``|``, ``#`` or END closes a unit.

    The last marked word is the nucleus; units keep fall, rise and fall-rise only and
    must last ``min_length`` seconds. ``hot`` are the ``hot_keys`` by path of all words or of rows that they
    were made of; without it they are counted.
    """
    spoken = words.filter(F.col("text") != "")
    closes = (F.col("text").rlike(r"[|#]") | (F.col("text") == "END")).cast("bigint")
    marked = running(spoken, ["path"], ["idx"], {"_closed": closes}, F.expr("idx div 1024"), True if hot is None else hot).withColumns(
        {"unit": F.col("_closed") - closes, "_m": tone_mark("text")})
    tone = F.when(F.col("_m.tone").isNotNull(), F.struct(
        F.col("_m.tone").alias("tone"), F.col("xmin").alias("at")))
    word = F.when(F.col("_m.text") != "", F.struct("idx", F.col("_m.text").alias("w")))
    units = marked.groupBy("path", "unit").agg(
        F.min_by("xmin", "idx").alias("start_s"), F.max_by("xmax", "idx").alias("end_s"),
        F.max_by(tone, F.when(tone.isNotNull(), F.col("idx"))).alias("_nucleus"),
        F.sort_array(F.collect_list(word)).alias("_words"))
    return units.filter(
        F.col("_nucleus.tone").isin("fall", "rise", "fall_rise")
        & (F.col("end_s") - F.col("start_s") >= min_length)
    ).select(
        "path", "unit", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"),
        F.round("_nucleus.at", 4).alias("nucleus_s"), F.col("_nucleus.tone").alias("expected_tone"),
        F.array_join(F.transform("_words", lambda w: w["w"]), " ").alias("transcript"))


def tone_slice(units: DataFrame, audio_end: Column, n_phones: Column, rate: int = 16_000) -> DataFrame:
    """Sample range around the nucleus, with a reason when it cannot be scored."""
    at = lambda s: F.floor(s * F.lit(float(rate)))
    step = lambda s: int(s * rate)
    start = F.greatest(F.lit(0), at(F.col("nucleus_s")) - step(0.1))
    end = F.least(at(audio_end), at(F.col("end_s")), at(F.col("nucleus_s")) + step(0.45))
    reason = F.when(n_phones < 2, "too few phones").when(end - start < step(0.3), "too short")
    return units.withColumns({"first_sample": start, "last_sample": end, "skip_reason": reason})


def refine_offsets(passages: Column, energy: Column, total_s: Column, frame_s: float = 0.02) -> Column:
    """Passage offsets inside a recording, each boundary snapped to the quietest frame.

    ``passages`` is an ordered array<struct<passage, duration>> and ``energy`` the frame
    energies of one recording. The fold carries the cursor over the passages and stops at
    the first passage that no longer fits.
    """
    start = F.struct(
        F.lit(0.0).alias("cursor"), F.lit(False).alias("stop"),
        F.array().cast("array<struct<passage:string,offset:double>>").alias("out"))
    frames = F.size(energy)

    def step(acc: Column, p: Column) -> Column:
        cursor, prior = acc["cursor"], acc["cursor"] + p["duration"]
        stop = acc["stop"] | (prior > total_s + 2.0)
        low = F.greatest(((cursor + 0.5) / frame_s).cast("int"), ((prior - 3.0) / frame_s).cast("int"))
        high = F.least(frames - 1, ((prior + 3.0) / frame_s).cast("int"))
        seen = F.slice(energy, low + 1, F.greatest(high - low + 1, F.lit(0)))
        quiet = low + F.array_position(seen, F.array_min(seen)) - 1
        after = F.when(high > low, quiet * F.lit(frame_s)).otherwise(F.least(prior, total_s))
        entry = F.struct(p["passage"].alias("passage"), cursor.alias("offset"))
        return F.struct(
            F.when(stop, cursor).otherwise(after).alias("cursor"), stop.alias("stop"),
            F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], F.array(entry))).alias("out"))

    return F.aggregate(passages, start, step, lambda acc: acc["out"])
