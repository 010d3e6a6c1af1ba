"""Label layer: mapping annotation labels to phones, tags, votes and vocabularies."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from phonoframe import tables as K
from phonoframe.functions import scalar as S
from phonoframe.operators.ranks import row_index, value_bucket


def quarantine(
    df: DataFrame, bad: Column, source: str, raw: str, reason: Column | str, seen: Observation | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split rows: the good ones, and (source, raw, reason) of the ones that cannot be used.

    ``seen`` receives ``rows`` and ``held`` (the unusable ones) when the good rows are first written or collected, in
    the same pass.
    """
    why = F.lit(reason) if isinstance(reason, str) else reason
    marked = df.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    if seen is not None:
        marked = marked.observe(seen, F.count("*").alias("rows"), F.count_if("_bad").alias("held"))
    good = marked.filter(~F.col("_bad")).drop("_bad")
    held = marked.filter("_bad").select(
        F.col(source).alias("source"), F.col(raw).alias("raw"), why.alias("reason"))
    return good, held


def _strict(value: Column, reason: Column, strict: bool) -> Column:
    if not strict:
        return value
    return F.when(reason.isNotNull(), F.raise_error(reason).cast("string")).otherwise(value)


def map_arpabet(df: DataFrame, label: str, strict: bool = False) -> DataFrame:
    """Add ``phone`` and ``reason``; silence markers and unknown labels carry a reason."""
    clean = F.trim(F.col(label))
    phone = S.arpabet(label)
    reason = F.when(S.isin(clean, K.ARPABET_SILENCE), F.lit("not a phone label")).when(
        phone.isNull(), F.lit("unknown phone"))
    return df.withColumns({"phone": _strict(phone, reason, strict), "reason": reason})


def map_tier_label(df: DataFrame, label: str, strict: bool = False) -> DataFrame:
    """Add ``phone`` and ``reason`` of hand-annotated labels; silence is null without reason."""
    phone = S.tier_phone(label)
    silent = S.is_tier_silence(F.trim(F.col(label))) | S.is_tier_silence(S.clean_tier_label(label))
    reason = F.when(phone.isNull() & ~silent, F.lit("unmappable label"))
    return df.withColumns({"phone": _strict(phone, reason, strict), "reason": reason})


def map_sampa(df: DataFrame, label: str, keep_ash: bool = False) -> DataFrame:
    """Keep rows whose label maps to a phone, with the phone in ``phone``.

    ``{`` is both the ash vowel and a structural label; it is dropped unless
    ``keep_ash`` is set.
    """
    table = {
        code: phone for code, phone in K.SAMPA.items()
        if code not in K.SAMPA_STRUCTURAL or (keep_ash and code == "{")
    }
    return df.withColumn("phone", S.lookup(table, F.col(label))).filter(F.col("phone").isNotNull())


def parse_tags(df: DataFrame, text: str) -> DataFrame:
    """Read ``target,realized,code`` tags.

    Adds state (kept / dropped / bad), phone, label, substituted_with and reason. A
    single comma or an unmappable tag target is an error and carries a reason that
    starts with ``error``.
    """
    part = lambda k: F.trim(F.get(F.split("_raw", ","), F.lit(k)))
    commas = F.length("_raw") - F.length(F.replace(F.col("_raw"), F.lit(","), F.lit("")))
    read = df.withColumn("_raw", F.trim(F.col(text))).withColumn("_commas", commas)
    tagged = F.col("_commas") == 2
    split = read.withColumns({
        "_code": F.when(tagged, S.lookup(K.TAG_CODES, F.lower(part(2)))),
        "_said": F.when(tagged, part(0)).otherwise(F.col("_raw"))})
    code = F.col("_code")
    # the label tables are consulted once per name: staged columns are not re-evaluated
    mapped = split.withColumns({
        "_phone": S.tier_phone("_said"), "_silent": S.is_tier_silence(F.col("_raw")),
        "_real": F.when(code == "s", S.tier_phone(part(1))),
        "_inserted": F.coalesce((code == "a") | F.lower(F.col("_said")).isin("sil", "sp"), F.lit(False))})
    silent, inserted, unmapped = F.col("_silent"), F.col("_inserted"), F.col("_phone").isNull()
    reason = (
        F.when(silent, F.lit(None).cast("string"))
        .when((F.col("_commas") > 0) & ~tagged, F.lit("error: unparsable annotation"))
        .when(tagged & code.isNull(), F.lit("unparsable tag code"))
        .when(tagged & ~inserted & unmapped, F.lit("error: tag target is not a phone"))
        .when(~tagged & unmapped, F.lit("unmappable label"))
    )
    dropped = silent | (tagged & code.isNotNull() & inserted)
    state = F.when(dropped, F.lit("dropped")).when(F.col("reason").isNotNull(), F.lit("bad")).otherwise(F.lit("kept"))
    judged = mapped.withColumn("reason", reason).withColumn("state", state)
    kept = F.col("state") == "kept"
    label = F.when(~tagged, F.lit("correct")).when(code == "s", F.lit("substituted")).otherwise(
        F.lit("deleted"))
    return judged.withColumns({
        "phone": F.when(kept, F.col("_phone")), "label": F.when(kept, label),
        "substituted_with": F.when(kept, F.col("_real")),
    }).drop("_raw", "_commas", "_code", "_said", "_phone", "_silent", "_real", "_inserted")


def token_sequence(tagged: DataFrame, key: str, order: str, bucket: Column | None = None) -> DataFrame:
    """Kept tokens with ``token_index`` counted after the drops, per utterance.

    ``bucket`` never decreases along ``order`` and says which tokens of an utterance are ordered
    together; by default a log scale of ``order``, a bounded number of buckets whatever its steps.
    """
    kept = tagged.filter(F.col("state") == "kept").drop("state", "reason")
    ranked = row_index(kept, [key], [order], value_bucket(order, 16) if bucket is None else bucket, "_n", sparse=True)
    return ranked.withColumn("token_index", F.col("_n") - 1).drop("_n")


def expert_votes(experts: Column, position: Column) -> Column:
    """How many expert phone lists bracket the phone at a 0-based position.

    ``experts`` holds the lines of :func:`voting_experts` and the counts of :func:`bracket_counts`.
    """
    return F.coalesce(F.get(experts["votes"], position), F.lit(0))


_BLANK, _BRACE = 1, 2
_SIGNS = bytes(_BLANK if b in b" \t\r\n" else _BRACE if b in b"{}" else 0 for b in range(256))


def translated(data: np.ndarray, table: bytes) -> np.ndarray:
    """Bytes by way of a table; several times faster than an index."""
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def _starts(inside: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Bytes at which a run inside a string begins."""
    after = np.zeros(len(inside), bool)
    after[1:] = inside[:-1]
    return inside & (opens | ~after)


def _opens(start: np.ndarray, size: int) -> np.ndarray:
    opens = np.zeros(size + 1, bool)
    opens[start] = True  # an empty string opens where the next one does
    return opens[:-1]


def _per_string(marks: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked bytes of each string, and those before it."""
    seen = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks.view(np.uint8), dtype=np.int32, out=seen[1:])
    before = seen[start]
    return (seen[stop] - before).astype(np.int64), before


def voting_experts(text: np.ndarray, lengths: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expert strings as words with one blank between them, without experts who disagree on the phone count; for use inside
    Arrow tasks.

    ``text`` has the bytes of all strings, ``lengths`` those of each (-1 is null), ``expected`` the phone count of its word.
    Returns a mark for each string that votes, and the lengths and bytes of the lines of these.
    """
    plain = np.maximum(lengths, 0)
    stop = np.cumsum(plain)
    start = stop - plain
    opens = _opens(start, len(text))
    signs = translated(text, _SIGNS)
    votes = (_per_string(_starts(signs == 0, opens), start, stop)[0] == expected) & (lengths >= 0)
    kept = signs != _BLANK
    begins = _starts(kept, opens)
    first, counts, before = np.flatnonzero(begins), *_per_string(begins, start, stop)
    later = np.ones(len(first), bool)
    later[before[counts > 0]] = False
    blank = np.zeros(len(text), bool)
    blank[np.compress(later, first) - 1] = True  # the one before each word but the first of its string
    kept = (kept | blank) & np.repeat(votes, plain)
    words = np.compress(kept, text)
    words[np.compress(kept, blank)] = ord(" ")
    return votes, _per_string(kept, start, stop)[0][votes], words


def bracket_counts(text: np.ndarray, lengths: np.ndarray, first: np.ndarray, expected: np.ndarray, phones: int) -> np.ndarray:
    """How many voting experts bracket each of the phones: their word at its position begins or ends with a brace.

    ``text`` and ``lengths`` are the lines of :func:`voting_experts`; ``first`` has the number of the first phone, and
    ``expected`` the phone count, of the word that each line is for.
    """
    stop = np.cumsum(lengths)
    start = stop - lengths
    begins = _starts(text != ord(" "), _opens(start, len(text)))
    counts, before = _per_string(begins, start, stop)
    position = np.arange(int(counts.sum())) - np.repeat(before, counts)
    begins = np.flatnonzero(begins)
    ends = np.append(begins[1:], len(text))[:len(begins)] - 1
    ends -= text[ends] == ord(" ")
    braces = (text == ord("{")) | (text == ord("}"))
    marked = braces[begins] | braces[ends]
    marked &= position < np.repeat(expected, counts)
    return np.bincount(np.compress(marked, np.repeat(first, counts) + position), minlength=phones)


def is_error(votes: Column, threshold: int = 3) -> Column:
    return votes >= threshold


def bind_vocab(table: DataFrame, vocab: DataFrame, required: DataFrame) -> DataFrame:
    """Problems and the blank index of binding a phone table to a vocabulary.

    ``table`` has canonical and token, ``vocab`` token and token_id, ``required``
    canonical. Returns (kind, item, token_id).
    """
    none = F.lit(None).cast("bigint")
    missing = required.join(table, "canonical", "left_anti").select(
        F.lit("missing phone").alias("kind"), F.col("canonical").alias("item"), none.alias("token_id"))
    absent = table.join(vocab, "token", "left_anti").select("token").distinct().select(
        F.lit("absent token").alias("kind"), F.col("token").alias("item"), none.alias("token_id"))
    shared = required.join(table, "canonical").groupBy("token").agg(F.count("*").alias("n")).filter(
        "n > 1").select(F.lit("shared token").alias("kind"), F.col("token").alias("item"),
                        none.alias("token_id"))
    preference = F.array_position(F.array(*[F.lit(b) for b in ("<pad>", "[PAD]", "pad")]), F.col("token"))
    blank = vocab.filter(preference > 0).agg(
        F.coalesce(F.min_by("token_id", preference), F.lit(0)).cast("bigint").alias("token_id"),
    ).select(F.lit("blank").alias("kind"), F.lit("").alias("item"), "token_id")
    return reduce(DataFrame.unionByName, [missing, absent, shared, blank])


def phone_of_token(table: DataFrame, tokens: DataFrame) -> DataFrame:
    """Inverse lookup token -> first canonical phone of the table; null outside it."""
    first = table.groupBy("token").agg(F.min_by("canonical", "position").alias("canonical"))
    return tokens.join(first, "token", "left")
