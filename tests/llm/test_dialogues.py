"""Repair of conversations against brute-force edits and a plain reading of the damage."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from phonoframe.llm import dialogues, queries

TURNS = "conv_id bigint, turn bigint, role string, text string, part string, codes int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def all_repairs(codes):
    """Least (cost, audit) by a table over suffixes, with no search order."""

    @lru_cache(None)
    def best(i, initials_state, room):
        found = []
        if i == len(codes) and initials_state in "-a":
            found.append((0, ""))
        following = "a" if initials_state == "u" else "u"
        if i < len(codes):
            ways = [("D", 2, initials_state)]
            if codes[i] != "x":
                extra = 5 * codes[i].isupper()
                c = codes[i].lower()
                if c == following or (c == "s" and initials_state == "-"):
                    ways.append(("K", extra, c))
                ways.append(("R", 1 + extra, following))
            for edit, cost, state in ways:
                rest = best(i + 1, state, 3)
                if rest:
                    found.append((cost + rest[0], edit + rest[1]))
        if room:
            rest = best(i, following, room - 1)
            if rest:
                found.append((5 + rest[0], "I" + rest[1]))
        return min(found, default=None)

    return best(0, "-", 3)


def test_search_finds_the_least_audit_of_all_cheapest_ones():
    rng = random.Random(5)
    words = ["".join(w) for n in range(4) for w in itertools.product("suaoAx", repeat=n)]
    words += ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(4, 14))) for _ in range(400)]
    for word in words:
        assert dialogues.cheapest(word, 0, (0, 3)) == all_repairs(word), word


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    out = {}
    damaged = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        codes, seen, counts = "", set(), [0, 0, 0]
        for _, _, role, text in mine:
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            shown = WORD.findall(text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes += "x" if fault in (0, 1) else c.upper() if fault == 2 else c
        numbers = {r[1] for r in mine if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = all_repairs(codes)
        lines, state, rest = [], "-", iter(mine)
        for edit in audit:
            row = None if edit == "I" else next(rest)
            if edit != "D":
                state = row[2][:1] if edit == "K" else "a" if state == "u" else "u"
                role = row[2] if edit == "K" else {"u": "user", "a": "assistant"}[state]
                lines.append(f"{role}:{row[3] if row else ''}")
        assert legal("".join(x[0] for x in lines))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        turn = rng.randint(-20, 5)
        for k in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 1, 2, 7])
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            role = rng.choice(["system", "tool", "", None]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "No!", "Why?", f"line {rng.randrange(50)}.", "cut of", " \t", None, f"é {k}?\n"])
            rows.append((conv, turn, role, text))
    return rows


def found(spark, tmp_path, rows, monkeypatch=None, part_turns=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    if part_turns:
        for name in ("plan_repairs", "apply_repairs"):
            full = getattr(dialogues, name)
            monkeypatch.setattr(dialogues, name, lambda *a, f=full: f(*a, part_turns=part_turns))
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations(1, 150, 9) + [(None, 4, "user", "Hi."), (None, 6, "assistant", "Hi."), (900, None, None, None)]
    assert found(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("part_turns", [1, 3])
def test_parts_of_long_conversations_do_not_change_the_result(spark, tmp_path, monkeypatch, part_turns):
    rows = conversations(2, 25, 40)
    assert found(spark, tmp_path, rows, monkeypatch, part_turns) == brute(rows)


def test_very_long_text_ties_and_missing_numbers(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 1, "assistant", long + "."), (2, None, "user", "A."),
            (2, None, "user", "A."), (2, 3, "assistant", "B.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    plans = dialogues.plan_repairs(df, 1)
    report = {r.conv_id: r for r in dialogues.dialogue_report(plans).collect()}
    assert tuple(report[1])[1:] == (0, 0, 1, 1, 1, *all_repairs("Uax"))
    assert report[2].audit == "KDK" and report[2].cost == 2 and report[2].gaps == 0
    kept = dialogues.apply_repairs(df, plans, 1).filter("conv_id = 2").orderBy("part", "place").collect()
    assert [(r.role, r.text) for r in kept] == [("user", "A."), ("assistant", "B.")]


@pytest.mark.parametrize("kind", [T.LongType(), T.StringType()])
def test_empty_table(spark, kind):
    df = spark.createDataFrame([], T.StructType([
        T.StructField("conv_id", kind), T.StructField("turn", T.IntegerType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    plans = dialogues.plan_repairs(df)
    assert plans.collect() == [] and dialogues.dialogue_report(plans).collect() == []
    assert dialogues.apply_repairs(df, plans).collect() == []
