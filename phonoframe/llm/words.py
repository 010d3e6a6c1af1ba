"""Words of whole transcripts as flat numpy arrays, for use inside Arrow tasks.

Bytes are enough for both word classes of this package: every byte of a multi-byte character is
0x80 or above, so ASCII separators never cut one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
_LETTERS = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _table(is_separator) -> bytes:
    lower = bytes(range(256)).lower()
    return bytes(32 if is_separator(b) else lower[b] for b in range(256))


BLANK = _table(lambda b: b in SPACES)
"""Words are runs of anything but ASCII white space."""
CASED = bytes(32 if b in SPACES else b for b in range(256))
"""Words as ``BLANK`` separates them, in the case they stand in."""
PLAIN = _table(lambda b: b < 128 and b not in _LETTERS)
"""Words are runs of ASCII letters, digits and any character from U+0080 on."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of several texts: byte range in ``data``, row of the text, 64-bit hash."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    rows: int
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a text column into runs of rows of about ``limit`` bytes; null is the empty text.

    After the last run, Arrow gives the memory of past batches back, as workers outlive their tasks.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_binary())
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        value = texts[i].as_py() or b""
        if held and size + len(value) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(value)
        size += len(value)
    if held:
        yield first, held
    pa.default_memory_pool().release_unused()


def find(texts: list[bytes], table: bytes) -> Words:
    """All words of the texts, separated and lower-cased (or not) as ``table`` says."""
    data = b" ".join(texts).translate(table)
    buf = np.frombuffer(data, np.uint8)
    inside = buf != 32
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - start
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    row = np.searchsorted(np.cumsum(sizes) - sizes, start, side="right") - 1
    return Words(data, start, end, row, len(texts), range_hashes(buf, start, end))


def range_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every (not empty) byte range."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(length.max()) + 1, _STEP, np.uint64))
        value = _BYTE[buf[np.repeat(start, length) + place]] * power[place]
        return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _STEP)


def chain(hashes: list[np.ndarray], seed: int) -> np.ndarray:
    """Hash of the sequence formed by equal places of the given arrays."""
    out = np.full(len(hashes[0]), seed + 1, np.uint64)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = mix(out * _STEP + h)
    return out


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of ``n`` words within one text."""
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(words.row[:count] == words.row[n - 1:])
    return first, chain([words.hash[first + j] for j in range(n)], n)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``n``-word shingles, ordered by row and hash.

    A text of fewer words, but at least one, has its whole sequence as its only shingle.
    """
    first, hashes = windows(words, n)
    rows = [words.row[first]]
    values = [hashes]
    counts = words.counts()
    begin = np.cumsum(counts) - counts
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            rows.append(short)
            values.append(chain([words.hash[begin[short] + j] for j in range(m)], m))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[fresh], value[fresh]


def per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Wrapping 64-bit sum of ``values`` for every row; ``row`` never decreases."""
    out = np.zeros(rows, np.uint64)
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[at]] = np.add.reduceat(values.astype(np.uint64, copy=False), at)
    return out
