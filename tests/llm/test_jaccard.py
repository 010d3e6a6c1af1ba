import random
import re

import pytest
from pyspark.sql import types as T

from phonoframe.llm import jaccard
from phonoframe.llm.jaccard import jaccard_join

SCHEMA = "utterance_id bigint, transcript string, n_shingles string, node int"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = {i: {i} for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= 75 * len(sets[i] | sets[j]):
                both = root[i] | root[j]
                for k in both:
                    root[k] = both
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[k][0] for k in root[i] if rows[k][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard_join(df).collect()), key=str)


def test_near_copies_match_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows, key = [], 100
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 60, 90]))]
        for _ in range(rng.choice([1, 2, 9])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += passage
            rows.append((key, " ".join(words)))
            key -= 1
    rows += [(500, rows[0][1].upper()), (501, " ".join(passage)), (502, " ".join(passage + ["tail"]))]
    assert found(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies_keeps_its_links(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for key in range(150):
        words = list(base)
        for place in rng.sample(range(80), rng.randint(0, 3)):
            words[place] = f"e{rng.randrange(10 ** 6)}"
        rows.append((key, " ".join(words)))
    assert found(spark, rows) == brute(rows)


def test_unlinked_texts_of_one_template_and_some_that_link(spark):
    rng = random.Random(5)
    template = [f"t{k}" for k in range(82)]
    rows = [(k, " ".join([f"own{k}x{j}" for j in range(22)] + template)) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + f" tail{k}") for k in range(0, 300, 40)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (9, "one"), (8, "ONE"), (7, "one two"), (None, "one"), (9, "one"),
            (5, long), (6, long + " end"), (4, "ÀÉ ÀÉ ÀÉ ÀÉ ÀÉ ÀÉ")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("kind", [T.LongType(), T.StringType()])
def test_empty_table(spark, kind):
    df = spark.createDataFrame([], T.StructType([
        T.StructField("utterance_id", kind), T.StructField("transcript", T.StringType())]))
    assert jaccard_join(df).collect() == []


def test_pairs_just_below_the_limit_fall_out_before_whole_sets_meet(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(40):  # copies with five words of their own: about 0.62 of the shingles of two are common
        at = set(rng.sample(range(0, 196, 7), 5))
        rows.append((i, " ".join(f"own{i}x{k}" if k in at else w for k, w in enumerate(base))))
    rows.append((40, rows[0][1] + " tail"))
    pairs, whole = [], jaccard._linked

    def counted(given, segments, percent):
        given = given.localCheckpoint()
        pairs.append(given.count())
        return whole(given, segments, percent)

    monkeypatch.setattr(jaccard, "_linked", counted)
    found = jaccard_join(spark.createDataFrame(rows, "utterance_id int, transcript string"))
    assert {r.utterance_id: r.component_id for r in found.collect()} == {**{i: i for i in range(40)}, 40: 0}
    assert pairs[-1] < 100  # of about 780
