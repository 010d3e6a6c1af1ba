"""Brute-force checks of operators that have no SQL counterpart."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phonoframe.functions.spectral import spectral_features
from phonoframe.functions.warp import dtw_distance
from phonoframe.operators import contour as C
from phonoframe.operators import frames as G
from phonoframe.operators import intervals as I
from phonoframe.operators import posteriors as P
from phonoframe.operators import ranks as R


def collapse(states, targets):
    return [targets[(s - 1) // 2] for s, prev in zip(states, [None, *states]) if s % 2 == 1 and s != prev]


def best_path_score(logp, targets):
    """Highest score over every legal state path, by enumeration."""
    states = 2 * len(targets) + 1
    symbol = [0 if s % 2 == 0 else targets[s // 2] for s in range(states)]
    best = -math.inf
    for path in itertools.product(range(states), repeat=len(logp)):
        if path[0] > 1 or path[-1] < states - 2:
            continue
        steps = [b - a for a, b in zip(path, path[1:])]
        if any(d < 0 or d > 2 for d in steps):
            continue
        if any(d == 2 and (b % 2 == 0 or symbol[b] == symbol[b - 2]) for d, b in zip(steps, path[1:])):
            continue
        best = max(best, sum(f[symbol[s]] for f, s in zip(logp, path)))
    return best, symbol


def test_forced_alignment_is_the_best_path(spark):
    rng = random.Random(4)
    cases = [([[rng.gauss(0, 2) for _ in range(4)] for _ in range(5)], t) for t in ([1, 2], [1, 1], [3], [2, 3, 2])]
    df = spark.createDataFrame(cases, "logits array<array<double>>, targets array<int>")
    rows = df.withColumn("frames", P.log_softmax("logits")).withColumn(
        "path", P.forced_align(F.col("frames"), F.col("targets"))).collect()
    for row in rows:
        best, symbol = best_path_score(row.frames, row.targets)
        assert abs(sum(f[symbol[s]] for f, s in zip(row.frames, row.path)) - best) < 1e-9
        assert collapse(row.path, row.targets) == row.targets


def test_alignment_refusals(spark):
    df = spark.createDataFrame([([[0.0, 0.0]], [1, 1]), ([[0.0, 0.0]], [5])], "f array<array<double>>, t array<int>")
    got = [r[0] for r in df.select(P.align_problem(F.col("f"), F.col("t"))).collect()]
    assert got[0].startswith("audio is too short to contain 2 phones (1 frames < 3") and "outside" in got[1]


def test_segments_tile_between_phones(spark):
    df = spark.createDataFrame([([0, 1, 1, 2, 2, 2, 3, 4, 5, 6],)], "path array<int>")
    segs = df.select(F.explode(P.phone_segments(F.col("path"), F.lit(3))).alias("s")).select("s.*").collect()
    assert [(s.start_frame, s.end_frame) for s in segs] == [(1, 5), (5, 8), (8, 9)]


def plain_dtw(a, b):
    cost = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost[0][0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i][j] = (x - y) ** 2 + min(cost[i - 1][j], cost[i][j - 1], cost[i - 1][j - 1])
    return cost[-1][-1] / (len(a) + len(b))


def test_dtw_against_the_full_table(spark):
    rng = random.Random(9)
    pairs = [([rng.gauss(0, 3) for _ in range(rng.randint(3, 12))], [rng.gauss(0, 3) for _ in range(rng.randint(3, 12))])
             for _ in range(25)] + [([1.0, 2.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(dtw_distance("a", "b")).collect()]
    assert got[-1] is None
    assert all(abs(g - plain_dtw(a, b)) < 1e-9 for g, (a, b) in zip(got, pairs[:-1]))


def test_offsets_snap_to_the_quiet_frame(spark):
    energy = [1.0] * 200
    for quiet in (51, 103):
        energy[quiet] = 0.0
    df = spark.createDataFrame([([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 9.0)], energy)],
                               "p array<struct<passage:string,duration:double>>, e array<double>")
    got = df.select(F.explode(I.refine_offsets(F.col("p"), F.col("e"), F.lit(4.0))).alias("o")).select("o.*").collect()
    assert [(r.passage, round(r.offset, 2)) for r in got] == [("a", 0.0), ("b", 1.02), ("c", 2.06)]


def test_steepest_glides_against_all_windows(spark):
    rng = random.Random(6)
    frames = [(1, i, i * 0.01, round(rng.gauss(0, 4), 3) if rng.random() < 0.8 else None) for i in range(120)]
    df = spark.createDataFrame(frames, "clip int, i int, t double, st double")
    pts = [(t, v) for _, _, t, v in frames if v is not None]
    slopes = [np.polyfit(*zip(*pts[a:b + 1]), 1)[0] for a in range(len(pts)) for b in range(a + 3, len(pts))
              if pts[b][0] - pts[a][0] <= 0.25 + 1e-6]
    row = C.glide_extremes(df).first()
    assert abs(row.s_min - min(slopes)) < 1e-6 and abs(row.s_max - max(slopes)) < 1e-6


def test_theil_sen_is_the_median_of_pairs(spark):
    rng = random.Random(8)
    pts = [(i * 0.01, rng.gauss(0, 2)) for i in range(21)]
    df = spark.createDataFrame([(pts,)], "p array<struct<t:double,v:double>>")
    want = np.median([(b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(pts, 2)])
    assert abs(df.select(C.theil_sen(F.col("p"))).first()[0] - want) < 1e-9


def tone_of(spark, values, hop=0.01):
    rows = [(1, i, i * hop, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "clip int, i int, t double, st double")
    row = C.nuclear_tone(df).first()
    return row.tone, row.confidence


def test_tones(spark):
    line = lambda slope, n=40: [slope * 0.01 * i for i in range(n)]
    assert tone_of(spark, line(-20))[0] == "fall"
    assert tone_of(spark, line(20) + [None] * 30)[0] == "rise"
    assert tone_of(spark, line(1))[0] == "level"
    dip = [-30 * 0.01 * min(i, 36 - i) for i in range(36)]
    assert tone_of(spark, dip) == ("fall_rise", 1.0)
    assert tone_of(spark, [None] * 20 + [1.0, 2.0]) == ("level", 0.0)


def test_long_clips_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    hz = [rng.uniform(80, 300) if rng.random() < 0.7 else None for _ in range(9000)]
    df = spark.createDataFrame([(1, i, i * 0.01, v) for i, v in enumerate(hz)], "clip int, i int, t double, hz double")
    got = {r.i: r.local for r in C.rolling_median(df).collect()}
    padded = np.pad(np.array([np.nan if v is None else v for v in hz]), 3, mode="edge")
    want = [np.nanmedian(padded[k:k + 7]) if not np.isnan(padded[k:k + 7]).all() else None for k in range(9000)]
    assert len(got) == 9000
    assert all((got[k] is None and w is None) or abs(got[k] - w) < 1e-9 for k, w in enumerate(want))
    runs = C.voiced_runs(df, "hz")
    assert runs.count() == sum(v is not None for v in hz)
    voiced = [i for i, v in enumerate(hz) if v is not None]
    starts = 1 + sum(b * 0.01 - a * 0.01 > 0.04 + 0.01 for a, b in zip(voiced, voiced[1:]))
    assert runs.agg(F.max("run")).first()[0] == starts


def test_augmentation_keeps_length_and_targets(spark):
    rows = [(k, [math.sin(i / 3) * 0.5 for i in range(200)]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, x array<double>").withColumn(
        "y", G.augment("x", "k", F.col("k") % 2 == 0))
    got = df.collect()
    assert all(len(r.y) == 200 for r in got)
    assert all(r.y == r.x for r in got if r.k % 2 == 0)
    changed = sum(r.y != r.x for r in got)
    assert 3 <= changed <= 30
    assert [r.y for r in df.collect()] == [r.y for r in got]


def test_spectral_cues_of_tones(spark):
    tone = lambda hz: [math.sin(2 * math.pi * hz * i / 16000) for i in range(1600)]
    df = spark.createDataFrame([(tone(2000.0),), (tone(6500.0),)], "x array<double>")
    low, high = [r.f for r in df.select(spectral_features("x", F.lit(16000)).alias("f")).collect()]
    assert low.sibilance < 0.1 and high.sibilance > 0.9
    assert abs(low.centroid * 8000 - 2000) < 60 and abs(high.rolloff * 8000 - 6500) < 60
    assert high.flatness < 0.1


def test_posteriors_sum_to_one_and_scores_agree(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(0, 2, (6, 5))
    df = spark.createDataFrame([(logits.tolist(), [1, 2, 4])], "l array<array<double>>, idx array<int>")
    df = df.withColumn("f", P.log_softmax("l"))
    closed = F.array(F.lit(2), F.lit(3))
    args = (F.col("f"), F.col("idx"), F.lit(1), closed)
    row = df.select(P.contrast_mean(*args).alias("m"), P.contrast_spike(*args).alias("s"),
                    P.contrast_vote(*args).alias("v")).first()
    logp = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    p = np.exp(logp[[1, 2, 4]])[:, [1, 2, 3]]
    mass = p.mean(0) / p.mean(0).sum()
    assert abs(sum(row.m.posteriors) - 1) < 1e-9 and np.allclose(row.m.posteriors, mass)
    assert abs(row.m.score - math.log(mass[1:].max() / mass[0])) < 1e-6
    assert abs(row.s - np.log(p[:, 1:].max(1) / p[:, 0]).max()) < 1e-6
    assert row.v == np.mean(p[:, 1:].max(1) > p[:, 0])


def test_runs_and_glides_do_not_assume_a_hop(spark):
    # frames 40 ms apart on a 1 ms grid, across the edge of a chunk of time
    times = [C.CHUNK_S - 0.06, C.CHUNK_S - 0.02, C.CHUNK_S + 0.02, C.CHUNK_S + 0.12]
    df = spark.createDataFrame([(1, round(t * 1000), t, 0.0) for t in times], "clip int, i int, t double, st double")
    assert [r.run for r in C.voiced_runs(df).orderBy("i").collect()] == [1, 1, 1, 2]
    steps = [(1, i, i * 0.001, 0.0 if i < 150 else 12.0) for i in range(300)]
    fine = spark.createDataFrame(steps, "clip int, i int, t double, st double")
    ts, vs = np.array([s[2] for s in steps]), np.array([s[3] for s in steps])
    best = max(
        (n * (x * v).sum() - x.sum() * v.sum()) / (n * (x * x).sum() - x.sum() ** 2)
        for a in range(300) for b in range(a + 3, 300) if ts[b] - ts[a] <= 0.25 + 1e-6
        for n, x, v in [(b - a + 1, ts[a:b + 1] - ts[a], vs[a:b + 1])])
    assert abs(C.glide_extremes(fine).first().s_max - best) < 1e-6
    early = C.glide_windows(fine, "st").filter("t = 0.1").first()
    assert early.high > 0  # the jump is 50 ms ahead


def test_chunks_cover_halos_wider_than_a_chunk(spark):
    df = spark.range(100).withColumn("k", F.lit(1))
    w = W.partitionBy("k", "_chunk")
    seen = R.own_rows(R.chunked(df, "id", 25, 10).withColumn("n", F.collect_list("id").over(w)))
    assert all({x for x in range(100) if abs(x - r.id) <= 25} <= set(r.n) for r in seen.collect())


def test_global_order_is_summed_in_groups(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    out = R.running(df, [], ["id"], {"s": F.col("v")}, F.expr("id div 2")).orderBy("id").collect()
    total = 0
    for r in out:
        total += r.v
        assert r.s == total
