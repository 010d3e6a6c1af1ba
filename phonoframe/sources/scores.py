"""Score files as flat numpy arrays inside Arrow tasks: one pass over the bytes of many lines instead of objects for each word.

A line is an object of utterances (``schemas.SCORES``), ``{id: {"words": [{"phones": [string, ..], ..}, ..], ..}, ..}``. Lines of exactly this shape are
read from their quotation marks and brackets, whatever their strings and further string members hold. Lines with escapes, control
characters, numbers, nulls, further levels or missing and repeated members are read by ``json``. A line that neither can read stops
the job."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from phonoframe.operators.labels import bracket_counts, translated, voting_experts

SLICE_BYTES = 1 << 19
"""Bytes of lines, or of packed strings, that are worked on at once; a longer line is a slice of its own."""
_CODEC = "zstd"

OBJECT, OBJECT_END, LIST, LIST_END, COLON, COMMA, STRING, KEY = range(1, 9)
_MARKS = b'{}[]:,"'
_KIND = bytes(_MARKS.find(b) + 1 for b in range(256))
_DEEPER = bytes([0, 1, 255, 1, 255]).ljust(256, b"\0")  # 255 is -1
_DEEPEST = 5  # 1 utterances, 2 an utterance, 3 its words, 4 a word, 5 its phones


def _followers() -> bytes:
    """For each pair of marks (9 times the first and the second) the depths, as bits, at which it may stand; 0 follows the last
    mark of a line. A depth counts behind the first mark."""
    ok = np.zeros((9, 9), np.uint8)

    def may(depth: int, first: int, *seconds: int) -> None:
        for second in seconds:
            ok[first, second] |= 1 << depth

    may(0, OBJECT_END, 0)
    for depth, values in ((1, [OBJECT]), (2, [STRING, LIST]), (4, [STRING, LIST])):
        may(depth, OBJECT, KEY, OBJECT_END)
        may(depth, KEY, COLON)
        may(depth, COLON, *values)
        may(depth, COMMA, KEY)
        for end in (STRING, OBJECT_END, LIST_END):
            may(depth, end, COMMA, OBJECT_END)
    for depth, value, end in ((3, OBJECT, OBJECT_END), (5, STRING, STRING)):
        may(depth, LIST, value, LIST_END)
        may(depth, COMMA, value)
        may(depth, end, COMMA, LIST_END)
    return ok.tobytes().ljust(256, b"\0")


_FOLLOWS = _followers()


@dataclass
class Strings:
    """The strings of all words of some utterances, in order. A string of length -1 is null."""

    ids: list[bytes]
    words: np.ndarray  # of each utterance
    sizes: np.ndarray  # strings of each word
    lengths: np.ndarray  # bytes of each string
    text: np.ndarray


def firsts(counts: np.ndarray) -> np.ndarray:
    """Where each of consecutive groups begins, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])


def _is(data: np.ndarray, start: np.ndarray, length: np.ndarray, word: bytes) -> np.ndarray:
    found = length == len(word)
    at = start[found]
    same = np.ones(len(at), bool)
    for i, byte in enumerate(word):
        same &= data[at + i] == byte
    found[found] = same
    return found


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[Strings, np.ndarray]:
    """The utterances of the lines of the plain shape, and a mark for each other line."""
    lines = len(offsets) - 1
    odd = np.zeros(lines, bool)
    line_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    bad = line_of(np.flatnonzero((data < 32) | (data == ord("\\"))))
    while True:
        if len(bad):  # they become blank lines
            data = data.copy() if not odd.any() else data
            for i in np.unique(bad).tolist():
                odd[i] = True
                data[offsets[i]:offsets[i + 1]] = 32
        found, bad = _scan(data, offsets, line_of)
        if not len(bad):
            return found, odd


def _scan(data: np.ndarray, offsets: np.ndarray, line_of: Callable) -> tuple[Strings | None, np.ndarray]:
    """The utterances, or the lines that are not of the plain shape; some of these may only be seen without the others."""
    quote = data == ord('"')
    odd = (np.cumsum(quote.view(np.uint8), dtype=np.int32) & 1).astype(bool)  # an odd number of quotation marks so far
    ended = offsets[1:] - 1
    uneven = np.flatnonzero(np.where(np.diff(offsets) > 0, odd[ended], 0)) if len(data) else ended[:0]
    if len(uneven):
        return None, uneven
    keep = quote == odd  # opening marks, and what stands outside of strings
    kind = translated(np.compress(keep, data), _KIND).copy()
    edge = firsts(np.array([np.count_nonzero(keep[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.int64))
    none = kind == 0
    if none.any():  # between the marks there are blanks only
        at = np.flatnonzero(keep)[none]
        other = at[data[at] != 32]
        if len(other):
            return None, line_of(other)
        edge -= firsts(none)[edge]
        kind = kind[~none]
    in_line = lambda tokens: np.searchsorted(edge, tokens, "right") - 1

    full = np.flatnonzero(edge[1:] > edge[:-1])
    first, last = edge[full], edge[full + 1] - 1
    depth = np.cumsum(translated(kind, _DEEPER).view(np.int8), dtype=np.int32)
    wrong = (depth[last] != 0) | (kind[first] != OBJECT) | (kind[last] != OBJECT_END)
    if wrong.any():
        return None, full[wrong]
    strings = np.flatnonzero(kind == STRING)
    keys = np.compress(kind[strings + 1] == COLON, strings)  # no line ends with a string
    kind[keys] = KEY
    follows = np.zeros(len(kind), np.uint8)
    follows[:-1] = kind[1:]
    follows[last] = 0
    level = np.clip(depth, 0, _DEEPEST + 1).astype(np.uint8)
    wrong = (translated(kind * 9 + follows, _FOLLOWS) >> level) & 1 == 0
    if wrong.any():
        return None, in_line(np.flatnonzero(wrong))

    code = level * 16 + kind
    within = code[strings]
    marks = np.flatnonzero(quote)
    opened, closed = marks[::2], marks[1::2]
    ids, words, held = strings[within == 16 + KEY], np.flatnonzero(code == 64 + OBJECT), {}
    for name, parents, deep in ((b"words", ids, 2), (b"phones", words, 4)):
        own = np.flatnonzero(within == deep * 16 + KEY)
        named = _is(data, opened[own] + 1, closed[own] - opened[own] - 1, name)
        wrong = own[named != (kind[strings[own] + 2] == LIST)]
        if len(wrong):  # another list, or no list
            return None, line_of(opened[wrong])
        held[name] = strings[own[named]] + 2
        if len(held[name]) != len(parents) or (held[name] < parents).any() or (held[name][:-1] > parents[1:]).any():
            each = np.bincount(np.searchsorted(parents, held[name], "right") - 1, minlength=len(parents))
            return None, in_line(parents[each != 1])

    named = within == 16 + KEY
    names = [data[a:b].tobytes() for a, b in zip((opened[named] + 1).tolist(), closed[named].tolist())]
    line = line_of(opened[named])
    for i in np.flatnonzero(np.bincount(line) > 1).tolist():
        mine = names[np.searchsorted(line, i):np.searchsorted(line, i, "right")]
        if len(set(mine)) < len(mine):
            return None, np.array([i])

    phones = within == _DEEPEST * 16 + STRING
    lengths = closed - opened - 1
    inside = np.compress(odd & ~quote, data)
    found = Strings(
        names, np.diff(np.append(np.searchsorted(words, ids), len(words))),
        np.diff(np.append(np.searchsorted(np.compress(phones, strings), held[b"phones"]), np.count_nonzero(phones))),
        np.compress(phones, lengths), np.compress(np.repeat(phones, lengths), inside))
    return found, np.zeros(0, np.int64)


def _member(value: object, kind: type, line: str) -> object:
    if value is not None and not isinstance(value, kind):
        raise ValueError(f"not a score file: {line[:200]}")
    return value or kind()


def parse(lines: list[str]) -> Strings:
    """The utterances of lines by way of ``json``; blank lines and nulls have none, missing members are empty."""
    ids, words, sizes, flat = [], [], [], []
    for line in lines:
        if not line.strip():
            continue
        for key, utterance in _member(json.loads(line), dict, line).items():
            here = [_member(_member(w, dict, line).get("phones"), list, line)
                    for w in _member(_member(utterance, dict, line).get("words"), list, line)]
            ids.append(key.encode("utf-8", "replace"))
            words.append(len(here))
            sizes.extend(map(len, here))
            flat.extend(itertools.chain.from_iterable(here))
    texts = [None if x is None else (x if isinstance(x, str) else json.dumps(x)).encode("utf-8", "replace") for x in flat]
    counts = lambda x: np.array(x, np.int64)
    return Strings(ids, counts(words), counts(sizes), counts([-1 if x is None else len(x) for x in texts]),
                   np.frombuffer(b"".join(x or b"" for x in texts), np.uint8))


# -- packed utterances -----------------------------------------------------------------


def _narrow(numbers: np.ndarray) -> tuple[int, bytes]:
    most = int(numbers.max(initial=0))
    width = 1 if most < 1 << 7 else 2 if most < 1 << 15 else 4
    return width, numbers.astype(f"<i{width}").tobytes()


def pack(found: Strings) -> Iterator[bytes]:
    """Each utterance as compressed bytes: strings of its words, lengths of the strings, the strings."""
    word, string = firsts(found.words), firsts(found.sizes)
    byte = firsts(np.maximum(found.lengths, 0))
    string = string[word]
    byte = byte[string]
    for u in range(len(found.ids)):
        (a, sizes), (b, lengths) = _narrow(found.sizes[word[u]:word[u + 1]]), _narrow(found.lengths[string[u]:string[u + 1]])
        whole = sizes + lengths + found.text[byte[u]:byte[u + 1]].tobytes()
        head = np.array([len(whole), a, len(sizes), b, len(lengths)], "<i8").tobytes()
        yield head + pa.compress(whole, _CODEC, asbytes=True)


def unpack(packed: list[bytes]) -> Strings:
    words, sizes, lengths, text = [], [], [], []
    for one in packed:
        size, a, to, b, more = np.frombuffer(one, "<i8", 5).tolist()
        whole = pa.decompress(memoryview(one)[40:], size, _CODEC, asbytes=True) if size else b""
        sizes.append(np.frombuffer(whole, f"<i{a}", to // a).astype(np.int64))
        lengths.append(np.frombuffer(whole, f"<i{b}", more // b, to).astype(np.int64))
        text.append(np.frombuffer(whole, np.uint8, -1, to + more))
        words.append(len(sizes[-1]))
    return Strings([], np.array(words, np.int64), *(np.concatenate(x) for x in (sizes, lengths, text)))


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for i, length in enumerate(lengths):
        if i > first and held + length > SLICE_BYTES:
            yield first, i
            first, held = i, 0
        held += length
    if lengths:
        yield first, len(lengths)


PACKED = "utterance_id string, packed binary"


def packed_utterances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a score file -> ``PACKED`` rows."""
    for batch in batches:
        column = batch.column(0).cast(pa.large_binary()).drop_null()
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        for a, b in _slices(np.diff(offsets).tolist()):
            found, odd = scan(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            rest = [bytes(data[offsets[a + i]:offsets[a + i + 1]]).decode("utf-8", "replace") for i in np.flatnonzero(odd).tolist()]
            for part in (found, parse(rest)) if rest else (found,):
                if part.ids:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.ids, pa.binary()).cast(pa.string()), pa.array(pack(part), pa.binary())], ["utterance_id", "packed"])


# -- words with their experts ------------------------------------------------------------

VOTED = "utterance_id string, first int, word_index int, phones array<string>, experts struct<lines:array<string>, votes:array<int>>"


def _strings(lengths: np.ndarray, text: np.ndarray) -> pa.Array:
    plain = np.maximum(lengths, 0)
    known = pa.array(lengths >= 0).buffers()[1] if len(lengths) and lengths.min() < 0 else None
    return pa.Array.from_buffers(pa.string(), len(lengths), [known, pa.py_buffer(firsts(plain).astype(np.int32)), pa.py_buffer(text)])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(firsts(counts), pa.int32()), values)


def vote(names: pa.Array, canonical: Strings, expert: Strings) -> pa.RecordBatch:
    """Each word with its phones, the number of phones before it, the lines of its voting experts and their votes for each phone."""
    utterance = np.repeat(np.arange(len(canonical.words)), canonical.words)
    index = np.arange(len(utterance)) - firsts(canonical.words)[utterance]
    phone = firsts(canonical.sizes)[:-1]
    both = np.flatnonzero(index < expert.words[utterance])
    other = firsts(expert.words)[utterance[both]] + index[both]  # the word of the experts
    expected, start = np.full(len(expert.sizes), -1), np.zeros(len(expert.sizes), np.int64)
    expected[other], start[other] = canonical.sizes[both], phone[both]
    expected, start = np.repeat(expected, expert.sizes), np.repeat(start, expert.sizes)
    votes, lengths, text = voting_experts(expert.text, expert.lengths, expected)
    brackets = bracket_counts(text, lengths, start[votes], expected[votes], len(canonical.lengths))
    voting = np.zeros(len(utterance), np.int64)
    string = firsts(expert.sizes)
    before = firsts(votes)
    voting[both] = before[string[other + 1]] - before[string[other]]
    return pa.RecordBatch.from_arrays([
        names.take(pa.array(utterance)), pa.array(phone - phone[firsts(canonical.words)[utterance]], pa.int32()), pa.array(index, pa.int32()),
        _lists(canonical.sizes, _strings(canonical.lengths, canonical.text)),
        pa.StructArray.from_arrays(
            [_lists(voting, _strings(lengths, text)), _lists(canonical.sizes, pa.array(brackets, pa.int32()))], ["lines", "votes"]),
    ], ["utterance_id", "first", "word_index", "phones", "experts"])


def voted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(utterance_id, canonical, expert), both packed -> ``VOTED`` rows."""
    for batch in batches:
        names = batch.column(0)
        canonical, expert = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in _slices([int.from_bytes(x[:8], "little") for x in expert]):
            yield vote(names.slice(a, b - a), unpack(canonical[a:b]), unpack(expert[a:b]))
