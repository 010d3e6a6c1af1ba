"""Surrogates for personal data in transcripts.

Entities are found by patterns; their canonical form (format aside) is mapped by a keyed permutation
onto the strings of the same shape, so equal entities always meet the same surrogate and different
ones of a shape never do. Names are composed from keyed parts of their gender and script. Two checks
need the whole corpus: no surrogate may be an entity that really occurs, and no two entities may share
one. They run as joins and groupings over the distinct entities; what fails is drawn again. Only the
few redrawn entities are sent back to the transcripts, all others are recomputed from the key.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.llm.sizes import small_side
from phonoframe.operators.storage import settle, store

# Given names by script and gender, and syllables that surnames are made of.
GIVEN_NAMES = {
    ("latin", "f"): ["Anna", "Maria", "Julia", "Sophie", "Laura", "Emma", "Elena", "Clara", "Alice", "Sarah", "Marie", "Carmen"],
    ("latin", "m"): ["Peter", "Paul", "Thomas", "Daniel", "David", "Martin", "Pablo", "Lucas", "Oliver", "James", "Pierre", "Jorge"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Николай", "Михаил", "Алексей", "Дмитрий"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Σοφία", "Άννα"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Ανδρέας"],
}
SYLLABLES = {
    "latin": ["bar", "bel", "dan", "del", "far", "fen", "gal", "har", "kel", "lan", "lor", "man", "mer", "nor", "pel", "ros",
              "sal", "ten", "tor", "val", "ver", "wil"],
    "cyrillic": ["бар", "вол", "гор", "дан", "кор", "лев", "мор", "нов", "пол", "рус", "сол", "тар"],
    "greek": ["βαλ", "γαρ", "δημ", "καλ", "λεο", "μαν", "νικ", "παλ", "ρος", "σαλ", "ταρ", "φιλ"],
}
# Shapes of entities; the first that matches at a place holds.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:(?:token|secret|password|passwd|api[_-]?key))\s*[=:]\s*[\"'](?P<secret>[A-Za-z0-9+/_=.-]{12,})[\"']"),
    ("ip", r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)"),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"),
    ("national_id", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
]
_ANY, _NO_CARD = (
    re.compile("|".join(f"(?P<{kind}_>{pattern})" for kind, pattern in PATTERNS if kind != without)) for without in ("", "card"))
_HINT = re.compile(r"[0-9@=:]")
_SCRIPT_LETTER = {"latin": r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'-]+", "cyrillic": r"[А-ЯЁ][а-яё-]+", "greek": r"[Ά-Ώ][ά-ώ-]+"}
_SURNAME = {s: re.compile(r" (" + p + r")(?!\w)") for s, p in _SCRIPT_LETTER.items()}


def luhn_digit(body: str) -> str:
    """The last digit that makes a card number valid."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


@functools.lru_cache(maxsize=1)
def _names() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for (script, gender), names in GIVEN_NAMES.items():
        for name in names:
            found.add_word(name, (name, script, gender))
    found.make_automaton()
    return found


def _is_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def _matches(text: str) -> Iterator[tuple[str, re.Match, int]]:
    """(kind, match, end) of the patterns in a text, in order, without overlaps.

    Where the digits of a card candidate fail the Luhn check, they may begin another entity, which other
    numbers follow: the other patterns are tried from the same start, then the shorter candidates that
    end before a separator, longest first; if nothing fits, the search goes on just after the start.
    """
    m = _ANY.search(text)
    while m:
        kind, end = m.lastgroup.rstrip("_"), m.end()
        if kind == "card" and not _is_card(re.sub(r"\D", "", m[0])):
            other = _NO_CARD.match(text, m.start())
            if other:
                m, kind, end = other, other.lastgroup.rstrip("_"), other.end()
            else:
                shorter = (m[0][:s.start()] for s in reversed(list(re.finditer("[ -]", m[0]))))
                digits = ((len(c), re.sub(r"\D", "", c)) for c in shorter)
                size = next((n for n, d in digits if len(d) >= 13 and _is_card(d)), 0)
                if not size:
                    m = _ANY.search(text, m.start() + 1)
                    continue
                end = m.start() + size
        yield kind, m, end
        m = _ANY.search(text, end)


def find_entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, canonical form) of the entities of a text, in order, without overlaps.

    Card numbers must pass the Luhn check. A person is a known given name followed by a capitalised
    word of its script.
    """
    out = []
    if _HINT.search(text):
        for kind, m, end in _matches(text):
            start, end = m.span("secret") if kind == "secret" else (m.start(), end)
            value = text[start:end]
            if kind == "email":
                canonical = value.lower()
            elif kind in ("ip", "secret"):
                canonical = value
            else:
                canonical = re.sub(r"\D", "", value)
            out.append((kind, start, end, canonical))
    for last, (name, script, gender) in _names().iter(text):
        start = last + 1 - len(name)
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@."):
            continue
        m = _SURNAME[script].match(text, last + 1)
        if m and not any(a < m.end() and start < b for _, a, b, _ in out):
            out.append((f"person:{script}:{gender}", start, m.end(), f"{name} {m[1]}"))
    return sorted(out, key=lambda e: e[1])


def _keyed(key: bytes, *parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=32).digest(), "big")


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on the next square, walked until it
    falls below ``size``."""
    if size < 2:
        return x
    half = int(np.ceil(np.sqrt(float(size)))) if size < 1 << 50 else 1 << ((size.bit_length() + 1) // 2)
    while half * half < size:
        half += 1
    while True:
        left, right = divmod(x, half)
        for turn in range(6):
            left, right = right, (left + _keyed(key, tweak, turn, right)) % half
        x = left * half + right
        if x < size:
            return x


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
_CLASS_OF = {c: group for group in _CLASSES for c in group}


def _reshape(key: bytes, tweak: str, value: str, fixed: tuple[int, ...] = ()) -> str:
    """The image of a string under the permutation of all strings of its shape."""
    groups = [None if i in fixed else _CLASS_OF.get(c) for i, c in enumerate(value)]
    if tweak.startswith("secret") and _HEX.fullmatch(value):
        groups = ["0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"] * len(value)
    shape = "".join("." if g is None else f"{g[0]}{len(g)}" for g in groups) + value[:len(fixed)]
    number, size = 0, 1
    for c, g in zip(value, groups):
        if g is not None:
            number = number * len(g) + g.index(c)
            size *= len(g)
    number = permute(key, f"{tweak}|{shape}", number, size)
    out = list(value)
    for i in reversed(range(len(out))):
        if groups[i] is not None:
            number, digit = divmod(number, len(groups[i]))
            out[i] = groups[i][digit]
    return "".join(out)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """Canonical form of the replacement of an entity."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        name, _, domain = canonical.partition("@")
        labels = domain.split(".")
        # the same domain always has the same surrogate; its last label stays
        moved = ".".join([*(_reshape(key, "domain", d) for d in labels[:-1]), labels[-1]])
        # short names have few images, so late attempts grow
        return f"{_reshape(key, tweak, name + 'x' * max(0, attempt - 3))}@{moved}"
    if kind == "card":
        body = _reshape(key, tweak, canonical[:-1])
        return body + luhn_digit(body)
    if kind == "ip":
        number = 0
        for octet in canonical.split("."):
            number = number * 256 + int(octet)
        number = permute(key, tweak, number, 1 << 32)
        return ".".join(str(number >> shift & 255) for shift in (24, 16, 8, 0))
    if kind.startswith("person:"):
        _, script, gender = kind.split(":")
        given, parts = GIVEN_NAMES[script, gender], SYLLABLES[script]
        draw = _keyed(key, tweak, canonical)
        draw, first = divmod(draw, len(given))
        surname = ""
        for _ in range(3 + attempt):  # more room with every attempt
            draw, k = divmod(draw, len(parts))
            surname += parts[k]
        return f"{given[first]} {surname.capitalize()}"
    # a phone number keeps what stands before its last ten digits
    return _reshape(key, tweak, canonical, tuple(range(len(canonical) - 10)) if kind == "phone" else ())


def dressed(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the mention's own format: separators of numbers, case of mail addresses."""
    if kind in ("card", "phone", "national_id"):
        digits = iter(replacement)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "email" and mention != mention.lower():
        return replacement.upper() if mention == mention.upper() else "".join(
            r.upper() if m.isupper() else r for m, r in itertools.zip_longest(mention, replacement, fillvalue=""))
    return replacement


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in WD.slices(batch.column(0)):
            found = [(first + i, kind, canonical) for i, text in enumerate(texts)
                     for kind, canonical in sorted({(e[0], e[3]) for e in find_entities(text.decode())})]
            take = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take), pa.array([f[1] for f in found], pa.string()),
                 pa.array([f[2] for f in found], pa.string())], names=["mark", "kind", "canonical"])


def _drawer(key: bytes):
    @F.pandas_udf(T.StringType())
    def draw(kind: pd.Series, canonical: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, int(a)) for k, c, a in zip(kind, canonical, attempt)], dtype=object)

    return draw


def redrawn_entities(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, attempt) of distinct entities whose first surrogate cannot be used.

    A surrogate is refused if it is an entity of the table, or if another entity has it too; then the
    entity of the smallest attempt and canonical form keeps it. Attempts rise until nothing is refused;
    names and mail addresses grow with them, and numbers have shapes far larger than any table.
    """
    draw = _drawer(key)
    real = entities.select(F.split("kind", ":")[0].alias("group"), F.col("canonical").alias("surrogate")).distinct()
    state = store(entities.withColumn("attempt", F.lit(0)).withColumn(
        "surrogate", draw("kind", "canonical", "attempt")).withColumn("group", F.split("kind", ":")[0]))
    while True:
        taken = state.join(real, ["group", "surrogate"], "left_semi").select("kind", "canonical")
        first = state.groupBy("group", "surrogate").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "canonical", "kind")).alias("owner")).filter("n > 1")
        shared = state.join(first, ["group", "surrogate"]).filter(
            F.struct("attempt", "canonical", "kind") != F.col("owner")).select("kind", "canonical")
        refused = store(taken.union(shared).distinct())
        if refused.isEmpty():
            return state.filter("attempt > 0").select("kind", "canonical", "attempt")
        again = state.join(refused.withColumn("refused", F.lit(1)), ["kind", "canonical"], "left").withColumn(
            "attempt", F.col("attempt") + F.coalesce("refused", F.lit(0)))
        state = store(again.withColumn(
            "surrogate", F.when(F.col("refused") == 1, draw("kind", "canonical", "attempt")).otherwise(F.col("surrogate"))
        ).drop("refused"))


_ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())])


def _replacer(key: bytes):
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            redrawn = batch.column(2).to_pylist()
            empty = batch.column(1).is_null().to_pylist()
            for first, texts in WD.slices(batch.column(1)):
                out, entities = [], []
                for i, raw in enumerate(texts):
                    text, at, parts, found = raw.decode(), 0, [], []
                    attempts = {(r["kind"], r["canonical"]): r["attempt"] for r in redrawn[first + i] or ()}
                    for kind, start, end, canonical in find_entities(text):
                        new = dressed(kind, text[start:end], surrogate(key, kind, canonical, attempts.get((kind, canonical), 0)))
                        parts += [text[at:start], new]
                        at = end
                        found.append({"kind": kind.split(":")[0], "start": start, "end": end, "surrogate": new})
                    out.append(None if empty[first + i] else "".join([*parts, text[at:]]))
                    entities.append(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(out, pa.string()), pa.array(entities, kind_of)],
                    names=["utterance_id", "transcript", "entities"])

    return run


def replace_entities(utterances: DataFrame, key: bytes) -> DataFrame:
    """Replace personal data in transcripts by keyed surrogates.

    ``utterances`` has ``utterance_id`` and ``transcript``; other columns are ignored. Mail and IP
    addresses, card and phone numbers, national ids, secrets and persons are found. An entity has the
    same surrogate wherever and in whatever format it occurs, no two entities share one, and none is
    an entity that occurs in ``utterances``. Surrogates keep type, format, script and, for persons,
    gender; card numbers stay valid; a mail domain has one surrogate of its own.

    Returns one row per input row: ``utterance_id``, ``transcript`` with surrogates and ``entities``
    (kind, start and end in the original characters, surrogate as written).

    Defined cases: a null transcript stays null and an empty one empty, both without entities;
    repeated rows give equal results; null ids are rows like any other; an empty table gives an empty
    result.
    """
    text = F.col("transcript").cast("string")
    source = utterances.select("utterance_id", text.alias("transcript"), F.xxhash64(text).alias("mark"))
    mentions = settle(source.select("transcript", "mark").mapInArrow(
        _mentions, "mark bigint, kind string, canonical string"))
    redrawn = redrawn_entities(mentions.select("kind", "canonical").distinct(), key)
    wanted = mentions.distinct().join(small_side(settle(redrawn)), ["kind", "canonical"]).groupBy("mark").agg(
        F.collect_list(F.struct("kind", "canonical", "attempt")).alias("redrawn"))  # of one text
    joined = source.join(small_side(settle(wanted)), "mark", "left").select("utterance_id", "transcript", "redrawn")
    schema = T.StructType([T.StructField("utterance_id", utterances.schema["utterance_id"].dataType),
                           T.StructField("transcript", T.StringType()), T.StructField("entities", T.ArrayType(_ENTITY))])
    return joined.mapInArrow(_replacer(key), schema)
