"""License scans of transcripts: fuzzy search for short notices.

Corpora of recordings carry license notices in their transcripts, often with small edits. A notice of
which at most k characters are edited has, cut into k + 1 pieces, one piece without an edit. All
pieces of all notices form one Aho-Corasick automaton that finds these exact seeds in one pass;
around each seed, the bounded-error matching of the ``regex`` library verifies the notice and gives
its span and errors. Texts go through Arrow tasks; nothing is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoframe.llm import words as WD

# Phrases that name a license wherever their words stand together.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
# Short notices, as lower-case words, and their labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license version", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd"),
    ("licensed under the eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
]
# Words so short that the edits of a notice could make them name another license.
NAMING_WORDS = frozenset({"mit", "gnu", "cc", "by", "nc", "sa", "nd"})
CHARACTERS_PER_ERROR = 15


class Scanner:
    """Seeds, patterns and phrases, built once for each Python worker."""

    def __init__(self, notices: tuple[tuple[str, str], ...], per_error: int, naming: frozenset[str] = frozenset()):
        self.notices = [(text, label, len(text) // per_error) for text, label in notices]
        self.patterns = [
            regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={k}}}") for text, _, k in self.notices]
        self.naming = naming
        self.names = [[w for w in text.split() if w in naming] for text, _, _ in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for j, (text, _, k) in enumerate(self.notices):
            cuts = [len(text) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((j, a))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the joined ranges of the text in which it can stand."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            start = end + 1 - size
            for j, offset in places:
                notice, _, k = self.notices[j]
                low, high = max(0, start - offset - k), min(len(text), start - offset + len(notice) + k)
                ranges = found.setdefault(j, [])
                if ranges and low <= ranges[-1][1]:
                    ranges[-1] = (min(low, ranges[-1][0]), max(high, ranges[-1][1]))
                else:
                    ranges.append((low, high))
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first and last character, errors, similarity) of every verified notice whose naming
        words stand unedited."""
        out = []
        for j, ranges in self.candidates(text).items():
            notice, label, _ = self.notices[j]
            for low, high in ranges:
                at = low
                while at < high and (m := self.patterns[j].search(text, at, high)):
                    if self.names[j] and [w for w in m[0].split() if w in self.naming] != self.names[j]:
                        at = m.start() + 1
                        continue
                    errors = sum(m.fuzzy_counts)
                    out.append((label, m.start(), m.end(), errors, 1 - errors / len(notice)))
                    at = max(m.end(), at + 1)
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=4)
def scanner(notices: tuple[tuple[str, str], ...], per_error: int, naming: frozenset[str] = frozenset()) -> Scanner:
    return Scanner(notices, per_error, naming)


def phrase_places(words: WD.Words, phrases) -> list[tuple[np.ndarray, str]]:
    """First words of every place where the words of a phrase stand together."""
    out = []
    for phrase, label in phrases:
        wanted = WD.find([phrase.encode()], WD.BLANK).hash
        size = len(words.hash) - len(wanted) + 1
        if size <= 0:
            continue
        hit = words.row[:size] == words.row[len(wanted) - 1:]
        for j, h in enumerate(wanted):
            hit &= words.hash[j:j + size] == h
        out.append((np.flatnonzero(hit), label))
    return out


_SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first_word", T.IntegerType()),
    T.StructField("last_word", T.IntegerType()), T.StructField("errors", T.IntegerType()),
    T.StructField("similarity", T.DoubleType())])


def scan_licenses(
    utterances: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
    characters_per_error: int = CHARACTERS_PER_ERROR,
) -> DataFrame:
    """Find license phrases and, with up to one edit for every ``characters_per_error`` characters,
    license notices in transcripts.

    ``utterances`` has ``utterance_id`` and ``transcript``; other columns are ignored. Words are runs
    of ASCII letters and digits (A-Z lower-cased) and characters from U+0080 on; notices are matched
    against the words joined by blanks. ``NAMING_WORDS`` of a notice must stand unedited.

    Returns one row per input row: ``utterance_id``, ``n_words``, ``places`` (first words of all
    places of phrases, words from 0, in order), ``base_labels`` (of the phrases), ``labels`` (of
    phrases and notices; both distinct and sorted), ``score`` (1 with a phrase, else the largest
    similarity of a notice, else 0) and ``spans`` (label, first and last word, edited characters and
    similarity of each notice).

    Defined cases: a null or empty transcript has no words, labels or score; repeated rows and null
    ids are rows like any other; an empty table gives an empty result.
    """
    fixed, base = tuple(map(tuple, notices)), [tuple(p) for p in phrases]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.ArrayType(T.StringType()),
             T.DoubleType(), T.ArrayType(_SPAN)]
    names = ["n_words", "places", "base_labels", "labels", "score", "spans"]
    arrow = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(),
             pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("last_word", pa.int32()),
                                 ("errors", pa.int32()), ("similarity", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(fixed, characters_per_error, NAMING_WORDS)
        for batch in batches:
            for first, texts in WD.slices(batch.column(1)):
                words = WD.find(texts, WD.PLAIN)
                counts = words.counts()
                begin = np.cumsum(counts) - counts
                places: list[list[int]] = [[] for _ in texts]
                labels: list[set[str]] = [set() for _ in texts]
                for at, label in phrase_places(words, base):
                    for row, place in zip(words.row[at].tolist(), (at - begin[words.row[at]]).tolist()):
                        places[row].append(place)
                        labels[row].add(label)
                rows = []
                for i, text in enumerate(texts):
                    joined = b" ".join(text.translate(WD.PLAIN).split()).decode()
                    spans = [
                        {"label": label, "first_word": joined.count(" ", 0, a + 1), "last_word": joined.count(" ", 0, b - 1),
                         "errors": e, "similarity": s} for label, a, b, e, s in search.scan(joined)]
                    score = 1.0 if labels[i] else max((s["similarity"] for s in spans), default=0.0)
                    rows.append((int(counts[i]), sorted(places[i]), sorted(labels[i]),
                                 sorted({*labels[i], *(s["label"] for s in spans)}), score, spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     *(pa.array(c, k) for c, k in zip(map(list, zip(*rows)), arrow))], names=["utterance_id", *names])

    return utterances.select("utterance_id", F.col("transcript").cast("string").alias("transcript")).mapInArrow(
        run, T.StructType([T.StructField("utterance_id", utterances.schema["utterance_id"].dataType),
                           *(T.StructField(n, k) for n, k in zip(names, kinds))]))
