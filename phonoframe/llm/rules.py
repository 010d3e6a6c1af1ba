"""Quality rules for transcripts under weak supervision.

Every rule votes good or bad or abstains. How often each rule votes wrongly on good and on bad
transcripts is unknown and is estimated by expectation maximisation over the counts of vote patterns,
which grouped aggregation brings down to at most 3 to the power of the number of rules. The posterior
probability of good, under the estimated accuracies, decides instead of a demand that all rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD
from phonoframe.operators.storage import settle

SYMBOLS = b"#*$%&|<>"
# Frequent function words of the languages that transcripts come in.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "was", "as", "be", "on", "are",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "du", "par", "pour", "dans",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "auf", "im",
    "el", "los", "las", "y", "un", "una", "por", "con", "para", "del", "se", "no", "es", "su", "al",
]
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_function_words",
    "n_letter_words", "n_closed_lines",
]
_FUNCTION_HASHES = np.unique(WD.find([w.encode() for w in FUNCTION_WORDS], WD.BLANK).hash)
_CLOSING = tuple(b".!?:;\"')]}")


def _bytes_in(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_IS_SYMBOL = _bytes_in(SYMBOLS)
_IS_LETTER = _bytes_in(bytes(b for b in range(256) if b >= 128 or bytes([b]).isalpha()))


def count_texts(texts: list[bytes]) -> np.ndarray:
    """The ``COUNTS`` of every text, one column each."""
    words = WD.find(texts, WD.CASED)
    buf = np.frombuffer(words.data, np.uint8)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    n = out[:, 0] = words.counts()

    def of_words(flags: np.ndarray) -> np.ndarray:
        """Set bytes of every word."""
        total = np.append(0, np.cumsum(flags))
        return total[words.end] - total[words.start]

    def of_rows(values: np.ndarray) -> np.ndarray:
        return WD.per_row(values.astype(np.uint64), words.row, len(texts)).astype(np.int64)

    out[:, 1] = of_rows(of_words((buf & 0xC0) != 0x80))
    out[:, 2] = of_rows(of_words(_IS_SYMBOL[buf]))
    first, gram = WD.windows(words, 3)
    if len(first):
        order = np.lexsort((gram, words.row[first]))
        row, value = words.row[first][order], gram[order]
        same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        twice = first[order[np.append(same, False) | np.insert(same, 0, False)]]
        repeat = np.zeros(len(words.row), bool)
        for j in range(3):
            repeat[twice + j] = True
        out[:, 4] = of_rows(repeat)
    folded = WD.range_hashes(np.frombuffer(words.data.lower(), np.uint8), words.start, words.end)
    out[:, 6] = of_rows(np.isin(folded, _FUNCTION_HASHES))
    out[:, 7] = of_rows(of_words(_IS_LETTER[buf]) > 0)
    for i, text in enumerate(texts):
        lines = [line for line in text.split(b"\n") if line.strip(WD.SPACES)] if n[i] else []
        out[i, 3] = len(lines) - len(set(lines))
        out[i, 5] = len(lines)
        out[i, 8] = sum(line.rstrip(WD.SPACES)[-1] in _CLOSING for line in lines)
    return out


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) where ``bad`` holds, good (1) where ``good`` holds, else abstains (0)."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0)


RULES = [
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_size", "word_chars BETWEEN 3 * n_words AND 10 * n_words",
         "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("line_copies", "n_dup_lines = 0", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("repetition", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    Rule("function_words", "20 * n_function_words >= n_words", "100 * n_function_words < n_words"),
    Rule("letters", "10 * n_letter_words >= 9 * n_words", "10 * n_letter_words < 7 * n_words"),
    Rule("line_ends", "2 * n_closed_lines >= n_lines AND n_lines > 0", "10 * n_closed_lines < n_lines"),
]


def estimate(votes: np.ndarray, counts: np.ndarray, turns: int = 100_000) -> dict[str, np.ndarray]:
    """Share of good transcripts and the accuracies of rules, by expectation maximisation.

    ``votes`` has a row for each pattern, ``counts`` its transcripts. A rule that votes is right on
    good transcripts with probability ``good`` and on bad ones with probability ``bad``; abstaining
    says nothing. Weak beta priors keep the two classes from changing places and an unused rule at its
    start. Ends when no value moves by more than 1e-9; raises if that takes more than ``turns``.
    """
    share, good, bad = 0.9, np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.5)
    up, down = (votes > 0), (votes < 0)
    weight = counts / max(1, counts.sum())
    prior = 1e-3
    for _ in range(turns):
        odds = _log_odds(up, down, share, good, bad)
        p = 1 / (1 + np.exp(-odds))
        new_share = np.clip((weight @ p + prior * 0.9) / (weight.sum() + prior), 1e-6, 1 - 1e-6)
        pos, neg = weight * p, weight * (1 - p)
        new_good = (pos @ up + prior * 0.95) / (pos @ (up | down) + prior)
        new_bad = (neg @ down + prior * 0.5) / (neg @ (up | down) + prior)
        move = max(abs(new_share - share), np.abs(new_good - good).max(), np.abs(new_bad - bad).max())
        share, good, bad = new_share, new_good, new_bad
        if move < 1e-9:
            return {"share": np.float64(share), "good": good, "bad": bad}
    raise RuntimeError(f"accuracies of rules still move by {move:.1e} after {turns} turns")


def _log_odds(up, down, share, good, bad) -> np.ndarray:
    for_up, for_down = np.log(good) - np.log1p(-bad), np.log1p(-good) - np.log(bad)
    return np.log(share) - np.log1p(-share) + up @ for_up + down @ for_down


def _measure(text: int):
    """Add the counts of text column ``text`` to whatever columns a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in WD.slices(batch.column(text)):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(c) for c in count_texts(texts).T)], names=[*part.schema.names, *COUNTS])

    return run


def _measured(plain: DataFrame, text: str) -> DataFrame:
    schema = T.StructType([*plain.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return plain.mapInArrow(_measure(plain.columns.index(text)), schema)


def measure(utterances: DataFrame) -> DataFrame:
    """``utterance_id`` and the ``COUNTS`` of every transcript: words, characters in words, symbols,
    lines equal to an earlier one, words in 3-word windows that stand twice or more, lines with a
    word, function words, words with a letter, lines that end in closing punctuation."""
    return _measured(utterances.select(
        "utterance_id", F.col("transcript").cast("string").alias("transcript")), "transcript").drop("transcript")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _votes() -> Column:
    return F.array(*[r.vote().cast("tinyint") for r in RULES])


def accuracies(voted: DataFrame) -> dict[str, np.ndarray]:
    """Estimate from a frame with ``votes``; at most 3 ** len(RULES) pattern counts are collected."""
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    votes = np.array([list(p.votes) for p in patterns], int).reshape(-1, len(RULES))
    return estimate(votes, np.array([p.n for p in patterns], float))


def _posterior(found: dict[str, np.ndarray]) -> Column:
    up = np.log(found["good"]) - np.log1p(-found["bad"])
    down = np.log1p(-found["good"]) - np.log(found["bad"])
    odds = F.lit(float(np.log(found["share"]) - np.log1p(-found["share"])))
    for k in range(len(RULES)):
        vote = F.col("votes")[k]
        odds = odds + F.when(vote > 0, float(up[k])).when(vote < 0, float(down[k])).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge_quality(utterances: DataFrame, least_posterior: float = 0.5) -> DataFrame:
    """Judge transcripts by rules whose accuracies are estimated without labels.

    ``utterances`` has ``utterance_id`` and ``transcript``; other columns are ignored. Words are runs
    without ASCII white space, as they stand; only function words are found in any case.

    Returns one row per input row: ``utterance_id``, the ``COUNTS``, ``base_failed`` (fewer than 50
    words, or more than half of the words in repeated windows), ``votes`` (one of -1, 0, 1 for each of
    ``RULES``), ``posterior`` (probability of good) and ``kept`` (not ``base_failed`` and
    ``posterior`` at least ``least_posterior``).

    Defined cases: a null, empty or blank transcript has no words and fails; repeated rows and null
    ids are rows like any other; an empty table gives an empty result.
    """
    voted = settle(measure(utterances).withColumns({"base_failed": _base_failed(), "votes": _votes()}))
    return voted.withColumn("posterior", _posterior(accuracies(voted))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least_posterior))


def keep_good(utterances: DataFrame, least_posterior: float = 0.5) -> DataFrame:
    """The utterances that ``judge_quality`` keeps, with all their columns, whatever their names.

    Texts are measured once for the accuracies and once more for the verdict, which costs less than
    sending them through a shuffle to meet their verdicts.
    """
    found = accuracies(measure(utterances).select(_votes().alias("votes")))
    given = utterances.withColumn("transcript", F.col("transcript").cast("string"))
    names = given.columns
    plain = given.toDF(*[f"_given{k}" for k in range(len(names))])
    judged = _measured(plain, f"_given{names.index('transcript')}").withColumn("votes", _votes())
    return judged.filter(~_base_failed() & (_posterior(found) >= least_posterior)).select(*plain.columns).toDF(*names)
