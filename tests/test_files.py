"""Readers of written files, the shard store, long alignments and glides."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.functions import align
from phonoframe.operators import contour as C
from phonoframe.sources import files, shards


def long_grid(tiers):
    out = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", "xmax = 9", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for k, (name, rows) in enumerate(tiers):
        out += [f"    item [{k + 1}]:", '        class = "IntervalTier"', f'        name = "{name}"', "        xmin = 0", "        xmax = 9",
                f"        intervals: size = {len(rows)}"]
        for j, (low, high, text) in enumerate(rows):
            out += [f"        intervals [{j + 1}]:", f"            xmin = {low}", f"            xmax = {high}", f'            text = "{text}" ']
    return "\n".join(out) + "\n"


def short_grid(tiers):
    out = ['File type = "ooTextFile short"', '"TextGrid"', "", "0", "9", "<exists>", str(len(tiers))]
    for kind, name, rows in tiers:
        out += [f'"{kind}"', f'"{name}"', "0", "9", str(len(rows))]
        for low, high, text in rows:
            out += [str(low), *([str(high)] if kind == "IntervalTier" else []), f'"{text}"']
    return "\n".join(out) + "\n"


@pytest.fixture(params=["whole", "cut"])
def cut(spark, request):
    """Files are read whole, or in pieces of a kilobyte whose lines are put back into order."""
    names = [f"spark.sql.files.{k}" for k in ("openCostInBytes", "maxPartitionBytes")]
    before = [spark.conf.get(n) for n in names]
    if request.param == "cut":
        for n in names:
            spark.conf.set(n, "1k")
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def intervals(rng, n):
    texts = ["sil", "DH,Z,s", "", 'a "b" c', "xmin = 3", "intervals [2]:", "é ˈiː", "item [9]:"]
    return [(k / 8, (k + 1) / 8, rng.choice(texts)) for k in range(n)]


def test_long_textgrids_of_any_size(spark, tmp_path, cut):
    rng = random.Random(1)
    wanted = []
    for f in range(3):
        tiers = [(f"t{k}", intervals(rng, n)) for k, n in enumerate((0, 200, 1, 90 * f))]
        (tmp_path / f"f{f}.TextGrid").write_text(long_grid(tiers), encoding="utf-8")
        wanted += [(f"f{f}.TextGrid", name, j, *r) for name, rows in tiers for j, r in enumerate(rows)]
    got = files.read_textgrid_long(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_short_textgrids_of_any_size(spark, tmp_path, cut):
    rng = random.Random(2)
    wanted = []
    for f in range(3):
        tiers = [(kind, f"t{k}", [r for r in intervals(rng, n) if '"' not in r[2]])
                 for k, (kind, n) in enumerate((("IntervalTier", 150), ("TextTier", 0), ("TextTier", 80 * f), ("IntervalTier", 1)))]
        (tmp_path / f"f{f}.TextGrid").write_text(short_grid(tiers), encoding="utf-8")
        wanted += [(f"f{f}.TextGrid", "interval" if kind == "IntervalTier" else "point", name, j, low, high if kind == "IntervalTier" else low, text)
                   for kind, name, rows in tiers for j, (low, high, text) in enumerate(rows)]
    got = files.read_textgrid_short(spark, str(tmp_path)).withColumn("path", F.substring_index("path", "/", -1))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_durations_of_any_size(spark, tmp_path, cut):
    lines = [f"A{k % 100:02d}{k % 90:02d}B.SIG\t{k / 4} 16000" if k % 5 else "" for k in range(300)]
    (tmp_path / "durations").write_text("\r\n".join(lines) + "\n")
    got = files.read_durations(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.block, r.duration) for r in got] == [(k, f"A{k % 100:02d}", k / 4) for k in range(300) if k % 5]


@pytest.mark.parametrize("reader, text", [
    (files.read_textgrid_long, "x"), (files.read_textgrid_long, long_grid([("a", [(0, 1, "x")])]).replace("tiers?", "t")),
    (files.read_textgrid_long, long_grid([("a", [(0, 1, "x")])]).replace("IntervalTier", "TextTier")),
    (files.read_textgrid_long, long_grid([("a", [(0, 1, "x")])]).replace("            xmin = 0\n", "")),
    (files.read_textgrid_short, "x"), (files.read_textgrid_short, short_grid([("Odd", "a", [])])),
    (files.read_textgrid_short, short_grid([("TextTier", "a", [(0, 1, "x")])]).rsplit("\n", 2)[0])])
def test_broken_files_stop(spark, tmp_path, reader, text):
    (tmp_path / "f").write_text(text)
    with pytest.raises(Exception):
        reader(spark, str(tmp_path)).collect()


# -- shards ----------------------------------------------------------------------------


def clips(spark, n=23):
    rows = [(k // 5, f"c{k}", f"s{k % 3}", "ð z", "train", 3 * (k % 5), 3, [float(k * 10 + j) for j in range(6)]) for k in range(n)]
    return spark.createDataFrame(rows, shards.SCHEMA)


def test_shards_round_trip_and_skip_torn_ones(spark, tmp_path):
    path = str(tmp_path / "store")
    shards.write_shards(clips(spark), path, 2)
    got = sorted(map(tuple, shards.read_shards(spark, path).collect()))
    assert got == sorted(map(tuple, clips(spark).collect()))
    entries = shards.manifest(path)["shards"]
    assert [(e["shard"], e["clips"], e["frames"]) for e in entries] == [(0, 5, 15), (1, 5, 15), (2, 5, 15), (3, 5, 15), (4, 3, 9)]
    (tmp_path / "store" / f"{entries[1]['name']}.npy").unlink()
    (tmp_path / "store" / f"{entries[3]['name']}.index.jsonl").unlink()
    assert {r.shard for r in shards.read_shards(spark, path).collect()} == {0, 2, 4}


def test_a_failed_write_leaves_the_last_shards(spark, tmp_path):
    path = str(tmp_path / "store")
    shards.write_shards(clips(spark), path, 2)
    before = shards.manifest(path)
    bad = clips(spark).withColumn("length", F.when(F.col("id") == "c22", 4).otherwise(F.col("length")))
    with pytest.raises(Exception):
        shards.write_shards(bad, path, 2)
    assert shards.manifest(path) == before and len(list((tmp_path / "store").glob("job-*"))) == 1
    shards.write_shards(clips(spark, 2), path, 2)
    assert shards.read_shards(spark, path).count() == 2


# -- sequences -------------------------------------------------------------------------


@pytest.mark.parametrize("frames, phones", [(1, 1), (9, 3), (60, 8), (257, 40), (30, 30), (12, 13)])
def test_replayed_alignment_equals_the_full_table(frames, phones):
    rng = np.random.default_rng(frames)
    logp = np.log(rng.dirichlet(np.ones(6), frames)).round(1)
    targets = rng.integers(1, 6, phones)
    full, replayed = (align._path(logp, targets, 0, kept) for kept in (1 << 30, 0))
    assert (full is None and replayed is None) or (full == replayed).all()


def test_alignment_of_a_hundred_thousand_frames_keeps_few_rows():
    import tracemalloc

    rng = np.random.default_rng(1)
    logp = np.log(rng.dirichlet(np.ones(8), 100_000)).astype(np.float64)
    targets = rng.integers(1, 8, 500)
    tracemalloc.start()
    path = align._path(logp, targets, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 100_000 and (np.diff(path) >= 0).all() and path[-1] >= 999 and peak < 20 << 20


def test_glides_equal_all_windows(spark):
    rng = random.Random(3)
    rows = []
    for clip in (None, "a", "b"):
        t, run = 0.0, 0
        for k in range(400):
            t += rng.choice([0.01, 0.01, 0.03, 0.2])
            run += rng.random() < 0.05
            rows.append((clip, k, round(t, 2), None if rng.random() < 0.1 else rng.uniform(-9, 9), run))
    df = spark.createDataFrame(rows, "clip string, i int, t double, st double, run int")
    got = {(r.clip, r.t): (r.low, r.high) for r in C.glide_windows(df, "st", run="run").collect()}
    said = [r for r in rows if r[3] is not None]
    assert got.keys() == {(r[0], r[2]) for r in said}
    for k, (clip, _, t, _, run) in enumerate(said):
        points, slopes = [], []
        for r in said[k:]:
            if (r[0], r[4]) != (clip, run) or r[2] - t > 0.25 + 1e-6:
                break
            points.append((r[2], r[3]))
            if len(points) >= 4:
                slopes.append(np.polyfit(*zip(*points), 1)[0])
        low, high = got[clip, t]
        assert (low is None) == (not slopes)
        if slopes:
            assert math.isclose(low, min(slopes), abs_tol=1e-6) and math.isclose(high, max(slopes), abs_tol=1e-6)
