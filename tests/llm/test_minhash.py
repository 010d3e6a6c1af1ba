"""b-bit MinHash against all pairs of full sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import jaccard, minhash
from phonoframe.llm import words as WD

SCHEMA = "utterance_id bigint, transcript string, n_shingles string, node int, bucket int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = {i: {i} for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                both = root[i] | root[j]
                for k in both:
                    root[k] = both
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[k][0] for k in root[i] if rows[k][0] is not None]
        component = min(ids) if ids else None
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)


def test_groups_of_copies_match_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, key = [], 500
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 90, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                words += passage
            rows.append((key, " ".join(words)))
            key -= 1
    # a chain whose ends do not link
    base = [f"c{k}" for k in range(120)]
    for step in range(12):
        rows.append((900 + step, " ".join(base[4 * step:] + [f"n{k}" for k in range(4 * step)])))
    rows += [(1000, rows[0][1].upper()), (1001, " ".join(passage))]
    assert found(spark, rows) == brute(rows)


def test_unlinked_texts_of_one_template_make_no_pairs(spark):
    """All share 80 of 100 words or so: every bucket is mixed, none of them links."""
    rng = random.Random(2)
    template = [f"t{k}" for k in range(90)]
    rows = [(k, " ".join([f"own{k}x{j}" for j in range(16)] + template)) for k in range(400)]
    # and some that do link
    rows += [(1000 + k, rows[k][1] + f" tail{k}") for k in range(0, 400, 50)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)
    given = [(g, k, 100, 80, k) for g in range(3) for k in range(300)] + [(7, k, 100, 95, k) for k in range(4)]
    members = spark.createDataFrame(given, "gram bigint, node bigint, n bigint, rest bigint, label bigint")
    pairs = sorted(tuple(r) for r in jaccard.reachable_pairs(members, 85).select("a", "b").collect())
    assert pairs == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_reachable_pairs_equal_the_filter_on_all_pairs(spark):
    rng = random.Random(4)
    given = [(rng.randrange(3), k, n := rng.randint(20, 60), rng.randint(n // 2, n), rng.randrange(30)) for k in range(120)]
    members = spark.createDataFrame(given, "gram bigint, node bigint, n bigint, rest bigint, label bigint")
    wanted = sorted(
        (a[1], b[1]) for a in given for b in given
        if a[0] == b[0] and a[1] < b[1] and a[4] != b[4] and 185 * min(a[3], b[3]) >= 85 * (a[2] + b[2])
        and 85 * max(a[2], b[2]) <= 100 * min(a[2], b[2]))
    assert wanted and sorted(tuple(r) for r in jaccard.reachable_pairs(members, 85).select("a", "b").collect()) == wanted


def test_estimates_are_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], []
    for common in (0, 500, 850, 1000):
        sets = rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)
        a, b = np.sort(sets[:1000]), np.sort(np.concatenate([sets[:common], sets[1000:]]))
        planes = minhash.signatures(np.repeat([0, 1], 1000), np.concatenate([a, b]), 2)[1]
        packed = planes.reshape(2, -1).view(np.int64)
        rows.append([int(x) for x in packed.ravel()])
        truth.append(common / (2000 - common))
    names = [f"a_{p}" for p in minhash.PLANES] + [f"b_{p}" for p in minhash.PLANES]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names))
    sides = [{p: F.col(f"{x}_{p}") for p in minhash.PLANES} for x in "ab"]
    got = [r[0] for r in df.select(minhash.similarity(*sides)).collect()]
    assert np.allclose(got, truth, atol=0.2) and got[-1] == 1.0 and 0.55 < minhash.margin(85) < 0.7


def test_edge_cases(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two"), (None, "one"), (9, "one"),
            (5, long), (6, long + " end"), (4, "ÀÉ ÀÉ ÀÉ ÀÉ ÀÉ ÀÉ"), (None, None), (9, long)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("kind", [T.LongType(), T.StringType()])
def test_empty_table(spark, kind):
    df = spark.createDataFrame([], T.StructType([
        T.StructField("utterance_id", kind), T.StructField("transcript", T.StringType())]))
    assert minhash.near_duplicates(df).collect() == []


def test_hashes_are_the_same_in_any_batch():
    words = WD.find([b"a b c d e f g", b"", b"x y z u v w"], WD.BLANK)
    row, value = WD.shingles(words, 5)
    together = minhash.signatures(row, value, 3)
    alone = minhash.signatures(row[row == 0], value[row == 0], 1)
    assert (together[0][0] == alone[0][0]).all() and (together[1][0] == alone[1][0]).all()


def united(edges):
    root = {}
    for a, b in edges:
        both = root.get(a, {a}) | root.get(b, {b})
        for k in both:
            root[k] = both
    return sorted((k, min(v)) for k, v in root.items())


@pytest.mark.parametrize("most", [0, 250_000])
def test_new_edges_extend_known_components(spark, monkeypatch, most):
    """In every turn the labels are those of all edges so far, whether they are broadcast or not."""
    monkeypatch.setattr(jaccard, "MOST_LABELS", most)
    rng = random.Random(7)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    turns = [[(rng.randrange(60), rng.randrange(60)) for _ in range(25)], list(zip(chain, chain[1:])), [],
             [(rng.randrange(80), rng.randrange(80)) for _ in range(15)] + [(chain[0], 0), (7, -3)]]
    known, seen = None, []
    for edges in turns:
        seen += edges
        frame = spark.createDataFrame(edges, "a bigint, b bigint")
        known = jaccard.components(frame, known)
        assert sorted(tuple(r) for r in known.collect()) == united(seen)


def test_few_edges_make_few_tasks(spark):
    """Tables of a loop do not get a file for every shuffle partition."""
    edges = spark.createDataFrame([(k, k // 3) for k in range(1, 60)], "a bigint, b bigint")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert {r.label for r in jaccard.components(edges).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    status = spark.sparkContext.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("few") for s in status.getJobInfo(j).stageIds}
    done = [i.numCompletedTasks for s in stages if (i := status.getStageInfo(s))]
    assert done and sum(done) < 120
