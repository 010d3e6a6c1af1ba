"""Hashed word n-grams and linear models trained by follow-the-regularised-leader updates.

A word's own hash and its shape (letters, digits and other characters as classes, repeats collapsed)
are two sequences; runs of one and two of either are features of 2 to the power ``bits`` places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from phonoframe.llm import words as WD

# a letter, a digit, a byte of a longer character, or the character itself
_CLASS = np.array([ord("a") if chr(b).isalpha() and b < 128 else ord("0") if chr(b).isdigit() and b < 128
                   else ord("a") if b >= 128 else b for b in range(256)], np.uint8)


def shapes(words: WD.Words) -> np.ndarray:
    """Hash of every word's shape."""
    if not len(words.hash):
        return np.zeros(0, np.uint64)
    kind = _CLASS[np.frombuffer(words.data, np.uint8)]
    change = np.append(True, kind[1:] != kind[:-1])
    change[words.start] = True
    order = np.cumsum(change)
    value = WD.mix(kind.astype(np.uint64) + np.uint64(1))
    rank = order - _spread(order[words.start], words.start, len(kind))
    with np.errstate(over="ignore"):
        power = WD.mix(np.minimum(rank, 8).astype(np.uint64))
        value = np.where(change, value * (power | np.uint64(1)), np.uint64(0))
        total = np.append(np.uint64(0), np.cumsum(value, dtype=np.uint64))
        return WD.mix(total[words.end] - total[words.start])


def _spread(values: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The value of the latest start at every place (0 before the first)."""
    out = np.zeros(size, values.dtype)
    out[start] = np.diff(values, prepend=0)
    return np.cumsum(out)


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all texts, ordered by row: distinct n-grams, each weighing one over
    the root of their number."""
    words = WD.find(texts, WD.BLANK)
    rows, places = [], []
    shape = WD.Words(words.data, words.start, words.end, words.row, words.rows, shapes(words))
    mask = np.uint64((1 << bits) - 1)
    for seed, sequence in ((1, words), (2, shape)):
        for n in (1, 2):
            first, value = WD.windows(sequence, n)
            rows.append(words.row[first])
            places.append((WD.mix(value + np.uint64(seed * 7919)) & mask).astype(np.int64))
    row, place = np.concatenate(rows), np.concatenate(places)
    key = np.unique((row.astype(np.int64) << bits) | place)
    row, place = key >> bits, key & int(mask)
    count = np.bincount(row, minlength=len(texts))
    return row, place, 1 / np.sqrt(np.maximum(count, 1))[row]


def terms(texts: list[bytes], bits: int, heads: tuple[int, ...] = (5, 7)) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all texts, ordered by row: distinct words and heads of words, in bytes."""
    words = WD.find(texts, WD.PLAIN)
    buf = np.frombuffer(words.data, np.uint8)
    values = [words.hash]
    for size in heads:
        cut = np.minimum(words.end, words.start + size)
        values.append(WD.mix(WD.range_hashes(buf, words.start, cut) + np.uint64(size)))
    mask = np.uint64((1 << bits) - 1)
    row = np.tile(words.row.astype(np.int64), len(values))
    key = np.unique((row << bits) | (np.concatenate(values) & mask).astype(np.int64))
    return key >> bits, key & int(mask)


@dataclass
class Ftrl:
    """Logistic regression by FTRL-proximal; ``n`` and ``z`` are its per-feature state."""

    size: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4

    def __post_init__(self):
        self.z = np.zeros(self.size)
        self.n = np.zeros(self.size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = np.abs(z) > self.l1
        return np.where(free, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        """One update by one example; ``place`` has no repeats."""
        w = self.weights(place)
        gradient = (sigmoid(float(w @ value)) - label) * value
        square = gradient * gradient
        step = (np.sqrt(self.n[place] + square) - np.sqrt(self.n[place])) / self.alpha
        self.z[place] += gradient - step * w
        self.n[place] += square


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def per_text(row: np.ndarray, rows: int, *columns: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The columns cut at the texts."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows)))
    return [tuple(c[a:b] for c in columns) for a, b in zip(ends[:-1], ends[1:])]


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, order: np.ndarray, size: int,
          passes: int, **options) -> np.ndarray:
    """Weights after some passes over (place, value) examples in the given order."""
    model = Ftrl(size, **options)
    for _ in range(passes):
        for i in order.tolist():
            model.learn(*examples[i], labels[i])
    return model.weights()


def dot(weights: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Sparse dot products of all texts with the weights."""
    return np.bincount(row, weights=weights[place] * value, minlength=rows)
