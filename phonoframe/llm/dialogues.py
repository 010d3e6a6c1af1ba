"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

The project has no records of dialogues, so the operator is general: ``turns`` has ``conv_id``,
``turn``, ``role`` and ``text``.

A conversation is repaired by the cheapest edits after which the initials of its roles read
``(s?(ua)+)?``: keep a turn, give it the role that fits, delete it, or insert an empty one. The edits
are edges of a lattice whose nodes are (turns read, what the last written turn was). Bidirectional
Dijkstra searches it: a heap from the start and one from the ends grow until the sum of their tops
exceeds the best crossing, so that every crossing of that cost is known; of these the least
concatenated audit (the initials of the edits) is taken.

A long conversation is cut at fixed turn numbers into parts, which are solved apart, for every state
a part can be entered and left in. Only those costs and the order of the audits meet in one task,
where the cheapest chain of states is chosen; texts and audits stay with their parts.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm.sizes import small_side
from phonoframe.operators.storage import settle

PART_TURNS = 512
"""Turn numbers in one part of a conversation."""
WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
"""Costs of edits; keeping is free, and a turn that ends in mid-sentence adds ``CUT_OFF`` if it stays."""
STATES = 4
"""Nothing written yet, then after a turn of system, user and assistant."""
_KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
_WRITTEN = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
_BEFORE = {t: [s for s in range(STATES) if _WRITTEN[s] == t] for t in range(STATES)}
_INF = 1 << 60


# -- the search ------------------------------------------------------------------------


def _step(code: str, state: int) -> list[tuple[int, int, str]]:
    """(next state, cost, initial of the edit) of reading one turn. Codes: the initial of the role, in
    upper case if the text is cut off; ``x`` for a turn that must go."""
    out = [(state, DELETE, "D")]
    if code != "x":
        extra = CUT_OFF if code.isupper() else 0
        kept = _KEPT.get((code.lower(), state))
        if kept is not None:
            out.append((kept, extra, "K"))
        out.append((_WRITTEN[state], REROLE + extra, "R"))
    return out


_AHEAD = {(c, s): _step(c, s) for c in "suaoSUAOx" for s in range(STATES)}
_BACK = {(c, t): [(s, w, e) for s in range(STATES) for to, w, e in _AHEAD[c, s] if to == t]
         for c in "suaoSUAOx" for t in range(STATES)}


def cheapest(codes: str, entry: int, exits: tuple[int, ...], last: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from ``entry`` to one of ``exits``, the least audit of equal ones.

    Turns are inserted before a turn, and after all of them only in the last part of a conversation.
    With that no audit of equal cost is the beginning of another one between the same two nodes, so
    the least whole audit consists of least halves. A free edit always reads a turn; heaps order equal
    costs by turns read, which makes a label final when its node leaves the heap.
    """
    n = len(codes)
    end = n + 1 if last else n
    ahead, back = {(0, entry): (0, "")}, {(n, s): (0, "") for s in exits}
    front, rear = [(0, 0, entry)], [(0, 0, s) for s in exits]
    done_ahead, done_back = set(), set()
    best = 0 if not n and entry in exits else _INF
    while front or rear:
        top_front = front[0][0] if front else _INF
        top_rear = rear[0][0] if rear else _INF
        if best < _INF and top_front + top_rear > best:
            break
        if top_front <= top_rear:
            cost, i, state = heapq.heappop(front)
            if (i, state) in done_ahead:
                continue
            done_ahead.add((i, state))
            audit = ahead[i, state][1]
            edges = [(i + 1, *e) for e in _AHEAD[codes[i], state]] if i < n else []
            if i < end:
                edges.append((i, _WRITTEN[state], INSERT, "I"))
            for j, to, weight, edit in edges:
                label = (cost + weight, audit + edit)
                if label < ahead.get((j, to), (_INF, "")):
                    ahead[j, to] = label
                    heapq.heappush(front, (label[0], j, to))
                    if (j, to) in back:
                        best = min(best, label[0] + back[j, to][0])
        else:
            cost, left, state = heapq.heappop(rear)
            i = n - left
            if (i, state) in done_back:
                continue
            done_back.add((i, state))
            audit = back[i, state][1]
            edges = [(i - 1, *e) for e in _BACK[codes[i - 1], state]] if i else []
            if i < end:
                edges += [(i, s, INSERT, "I") for s in _BEFORE[state]]
            for j, to, weight, edit in edges:
                label = (cost + weight, edit + audit)
                if label < back.get((j, to), (_INF, "")):
                    back[j, to] = label
                    heapq.heappush(rear, (label[0], n - j, to))
                    if (j, to) in ahead:
                        best = min(best, label[0] + ahead[j, to][0])
    met = [(ahead[k][0] + back[k][0], ahead[k][1] + back[k][1]) for k in ahead.keys() & back.keys()]
    return min(met, default=None)


@functools.lru_cache(maxsize=1 << 14)
def _whole(codes: str) -> tuple[int, str]:
    return cheapest(codes, 0, (0, 3))


@functools.lru_cache(maxsize=1 << 8)
def _table(codes: str, last: bool) -> tuple[list[int], list[int], list[str]]:
    """Costs and audits for every (entry, exit), and the order of the audits of an entry."""
    costs, audits, ranks = [], [], []
    for entry in range(STATES):
        found = [None if last and s not in (0, 3) else cheapest(codes, entry, (s,), last) for s in range(STATES)]
        costs += [_INF if f is None else f[0] for f in found]
        words = ["" if f is None else f[1] for f in found]
        audits += words
        ranks += [sorted(words).index(a) for a in words]
    return costs, ranks, audits


# -- parts of conversations ------------------------------------------------------------


def _prepared(turns: DataFrame) -> DataFrame:
    given = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return given.withColumns({
        "h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(7), "role")})


def _part(part_turns: int) -> Column:
    """Parts follow the order of turns: missing numbers first, spread by the hash that orders them."""
    spread = F.floor(F.col("h1") / F.lit(float(1 << 52))).cast("bigint")
    return F.when(F.col("turn").isNull(), F.lit(-(1 << 60)) + spread).otherwise(
        F.expr(f"(turn - pmod(turn, {part_turns}L)) div {part_turns}L"))


def _code() -> Column:
    """Initial of the role; in upper case if the text is cut off, a digit if it is blank."""
    shown = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(shown == "", F.translate(known, "suao", "1234")).when(
        F.substring(shown, -1, 1).isin(".", "!", "?"), known).otherwise(F.upper(known))


_INITIAL = str.maketrans("1234SUAO", "suaosuao")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in ("codes", "h1", "h2", "fresh", "long", "last")}
        out: list[tuple] = []
        for codes, h1, h2, fresh, long, last in zip(*columns.values()):
            known = {(f["h1"], f["h2"]) for f in fresh or []}
            seen: set = set()
            plain, counts = [], {"blank": 0, "duplicate": 0, "truncated": 0}
            for code, *content in zip(codes, h1, h2):
                content = tuple(content)
                repeat = content in seen or (long and content not in known)
                seen.add(content)
                fault = ("blank" if code.isdigit() else "duplicate" if repeat
                         else "truncated" if code.isupper() else None)
                if fault:
                    counts[fault] += 1
                plain.append(code if fault in (None, "truncated") else "x")
            initials = codes.translate(_INITIAL)
            illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))
            word = "".join(plain)
            cost, audit = (None, None) if long else _whole(word)
            costs, ranks, audits = _table(word, last) if long else (None, None, None)
            out.append((*counts.values(), illegal, initials[:1], initials[-1:], cost, audit, costs, ranks, audits))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [
            pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())]
        values = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
        keys = ("conv_id", "part", "turns", "low", "high", "long")
        yield pa.RecordBatch.from_arrays(
            [batch.column(name) for name in keys] + values,
            names=[*keys, "blank", "duplicate", "truncated", "illegal", "first", "final",
                   "cost", "audit", "costs", "ranks", "audits"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States at the borders of the parts of a conversation, whose rows come from the last part to the first."""
    held: list[tuple] = []
    total: list[int] = []
    owner: list = []

    def closed() -> pa.RecordBatch:
        rows, state = [], 0
        for k in range(len(held) - 1, -1, -1):
            part, choice, initials = held[k]
            before = held[k + 1][2][1] if k + 1 < len(held) else ""
            border = before + initials[0]
            rows.append((part, state, choice[state], int(bool(before) and border not in ("su", "ua", "au"))))
            state = choice[state]
        return pa.RecordBatch.from_arrays(
            [pa.array([owner[0]] * len(rows), kind), *[pa.array(list(c), pa.int64()) for c in zip(*rows)]],
            names=["conv_id", "part", "entry", "exit", "border"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "part", "costs", "ranks", "first", "final")
        for conv, part, costs, ranks, first, final in zip(*(batch.column(n).to_pylist() for n in names)):
            if held and owner != [conv]:
                yield closed()
                held = []
            if not held:
                owner, total = [conv], [0] * STATES
            choice, sums = [], []
            for entry in range(STATES):
                ways = [(costs[entry * STATES + s] + total[s], ranks[entry * STATES + s], s) for s in range(STATES)]
                least = min(ways)
                choice.append(least[2])
                sums.append(min(least[0], _INF))
            held.append((part, choice, (first, final)))
            total = sums
    if held:
        yield closed()


def plan_repairs(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The cheapest edits of every conversation, one row for each of its parts.

    ``turns`` has ``conv_id`` (any orderable type), ``turn``, ``role`` and ``text``; other columns are
    ignored, whatever their names. Turns are read by number, missing numbers first; turns of one number
    are ordered by hashes of their content. The first fault of a turn counts: blank (nothing but ASCII
    white space), duplicate (role and text stood earlier in the conversation), truncated (does not
    end in ``.``, ``!`` or ``?``). Blank and duplicate turns must be deleted.

    Returns ``conv_id``, ``part``, ``entry`` (state before the part), ``audit``, ``cost``, the counts
    ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose initials are not su, ua or au), and
    ``turns``, ``low``, ``high`` (distinct, smallest and largest turn number). ``part_turns`` changes
    how the work is cut, not what it returns.

    Defined cases: a null role or text is one space; a null ``conv_id`` is one conversation; an empty
    table gives an empty result. One part of a conversation is one task's work, so very many turns of
    the same number and conversation are the one group that is not cut.
    """
    rows = _prepared(turns).select("conv_id", _part(part_turns).alias("part"), "turn", "h1", "h2", _code().alias("code"))
    packed = settle(
        rows.groupBy("conv_id", "part").agg(
            F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "code"))).alias("rows"),
            F.min("turn").alias("low"), F.max("turn").alias("high"))
        .select(
            "conv_id", "part", "low", "high", F.array_join("rows.code", "").alias("codes"),
            F.size(F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))).cast("bigint").alias("turns"),
            F.col("rows.h1").alias("h1"), F.col("rows.h2").alias("h2")))
    spans = packed.groupBy("conv_id").agg(F.max("part").alias("_last"), F.count("*").alias("_parts")).filter("_parts > 1")
    spans = small_side(settle(spans.select(F.col("conv_id").alias("_conv"), "_last")))
    marked = packed.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").withColumns({
        "long": F.col("_last").isNotNull(), "last": F.coalesce(F.col("part") == F.col("_last"), F.lit(True))}
    ).drop("_conv", "_last")
    # the first part that holds a content; spread by part, so that a content of all parts is no hot key
    contents = marked.filter("long").select("conv_id", "part", F.explode(F.arrays_zip("h1", "h2")).alias("c"))
    fresh = (
        contents.groupBy("conv_id", "c").agg(F.min("part").alias("part"))
        .groupBy("conv_id", "part").agg(F.collect_list("c").alias("fresh"))
        .select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "fresh"))
    long = marked.filter("long").join(
        fresh, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left"
    ).drop("_conv", "_part")
    names = ["conv_id", "part", "turns", "low", "high", "codes", "h1", "h2", "fresh", "long", "last"]
    none = F.lit(None).cast(fresh.schema["fresh"].dataType)
    ready = marked.filter(~F.col("long")).withColumn("fresh", none).select(*names).union(long.select(*names))
    fields = [T.StructField("conv_id", turns.schema["conv_id"].dataType)] + [
        T.StructField(n, k) for n, k in [
            *[(n, T.LongType()) for n in ("part", "turns", "low", "high")], ("long", T.BooleanType()),
            *[(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal")],
            ("first", T.StringType()), ("final", T.StringType()), ("cost", T.LongType()), ("audit", T.StringType()),
            ("costs", T.ArrayType(T.LongType())), ("ranks", T.ArrayType(T.IntegerType())),
            ("audits", T.ArrayType(T.StringType()))]]
    solved = settle(ready.mapInArrow(_solve, T.StructType(fields)))
    chain_type = T.StructType([fields[0], *[T.StructField(n, T.LongType()) for n in ("part", "entry", "exit", "border")]])
    chains = (
        solved.filter("long").select("conv_id", "part", "costs", "ranks", "first", "final")
        .repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"))
        .mapInArrow(_chain, chain_type).withColumnsRenamed({"conv_id": "_conv", "part": "_part"}))
    cell = F.col("entry") * STATES + F.col("exit") + 1
    counts = ["blank", "duplicate", "truncated"]
    chosen = solved.filter("long").join(
        chains, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    ).select(
        "conv_id", "part", "entry", F.element_at("audits", cell.cast("int")).alias("audit"),
        F.element_at("costs", cell.cast("int")).alias("cost"), *counts,
        (F.col("illegal") + F.col("border")).alias("illegal"), "turns", "low", "high")
    return solved.filter(~F.col("long")).select(
        "conv_id", "part", F.lit(0).cast("bigint").alias("entry"), "audit", "cost", *counts, "illegal",
        "turns", "low", "high").union(chosen)


def dialogue_report(plans: DataFrame) -> DataFrame:
    """One row for each conversation of ``plan_repairs``: ``conv_id``, ``gaps`` (turn numbers missing between the
    smallest and the largest; 0 without any number), ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``
    and ``audit``, which is as long as the conversation."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "audit")))
    missing = F.max("high") - F.min("low") + 1 - F.sum("turns")
    return plans.groupBy("conv_id").agg(
        F.coalesce(missing, F.lit(0)).alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(pieces["audit"], "").alias("audit"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a part follow its plan; only the plan and one batch of turns are held."""
    audit, at, state, place = "", 0, 0, 0
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = ("conv_id", "part", "plan", "entry", "role", "text")
        out: list[tuple] = []

        def insert(conv, part):
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = _WRITTEN[state]
                out.append((conv, part, place, ROLES[state], ""))
                place, at = place + 1, at + 1

        for conv, part, plan, entry, role, text in zip(*(batch.column(n).to_pylist() for n in names)):
            if plan is not None:
                audit, at, state, place = plan, 0, entry, 0
                insert(conv, part)
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                state = _KEPT[role[:1], state] if edit == "K" else _WRITTEN[state]
                out.append((conv, part, place, role if edit == "K" else ROLES[state], text))
                place += 1
            insert(conv, part)
        if out:
            kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                names=["conv_id", "part", "place", "role", "text"])


def apply_repairs(turns: DataFrame, plans: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The repaired turns: ``conv_id``, ``part`` and ``place`` (their order), ``role``, ``text``.

    ``plans`` is what ``plan_repairs`` found for these turns and ``part_turns``. Kept turns have their
    role and text, the others the role that fits; inserted ones have an empty text. Parts are spread
    over tasks and streamed, so neither a long conversation nor a long text is held as a whole.
    """
    named = ["conv_id", "part", "kind", "turn", "h1", "h2", "plan", "entry", "role", "text"]
    none = F.lit(None)
    rows = _prepared(turns).withColumns({
        "part": _part(part_turns), "kind": F.lit(1), "plan": none.cast("string"), "entry": none.cast("bigint")})
    heads = plans.select("conv_id", "part", "entry", F.col("audit").alias("plan")).withColumns({
        "kind": F.lit(0), **{n: none.cast("bigint") for n in ("turn", "h1", "h2")},
        "role": none.cast("string"), "text": none.cast("string")})
    dealt = rows.select(*named).union(heads.select(*named)).repartition("conv_id", "part").sortWithinPartitions(
        "conv_id", "part", "kind", "turn", "h1", "h2")
    kept = T.StructType([
        T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("part", T.LongType()),
        T.StructField("place", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType())])
    return dealt.select("conv_id", "part", "plan", "entry", "role", "text").mapInArrow(_write, kept)
