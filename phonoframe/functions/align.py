"""Best CTC path of an utterance, Arrow-batched: one vector operation per frame over all states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


KEPT_STEPS = 1 << 22
"""Steps (frames x states) whose choices are kept at once; longer tables are replayed in pieces."""


def _advance(score: np.ndarray, logp: np.ndarray, symbol: np.ndarray, skip: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """Scores after the given frames; ``back`` takes the step chosen at each frame and state."""
    one, two = np.full((2, len(symbol)), -np.inf)
    for t, frame in enumerate(logp):
        one[1:] = score[:-1]
        two[2:] = np.where(skip[2:], score[:-2], -np.inf)
        if back is not None:
            back[t] = np.where((score >= one) & (score >= two), 0, np.where(one >= two, 1, 2))
        score = np.maximum(np.maximum(score, one), two) + frame[symbol]
    return score


def _path(frames: np.ndarray, targets: np.ndarray, blank: int, kept_steps: int = KEPT_STEPS) -> np.ndarray | None:
    """Best state at every frame. A table of more than ``kept_steps`` is passed twice: forwards keeping the scores at the
    begin of every piece of about the square root of the frames, then piece by piece from the end."""
    symbol = np.full(2 * len(targets) + 1, blank)
    symbol[1::2] = targets
    if not len(frames) or symbol.min() < 0 or symbol.max() >= frames.shape[1]:
        return None
    skip = np.zeros(len(symbol), bool)
    skip[2:] = (np.arange(2, len(symbol)) % 2 == 1) & (symbol[2:] != blank) & (symbol[2:] != symbol[:-2])
    score = np.full(len(symbol), -np.inf)
    score[:2] = frames[0, symbol[:2]]
    last = len(frames) - 1
    piece = max(last, 1) if last * len(symbol) <= kept_steps else int(np.ceil(np.sqrt(last)))
    starts = range(0, max(last, 1), piece)
    held = []
    for first in starts:
        held.append(score)
        if len(starts) > 1:
            score = _advance(score, frames[first + 1:first + 1 + piece], symbol, skip, None)
    path = np.empty(len(frames), np.int32)
    state = None
    for first, before in zip(reversed(starts), reversed(held)):
        part = frames[first + 1:first + 1 + piece]
        back = np.zeros((len(part), len(symbol)), np.int8)
        after = _advance(before, part, symbol, skip, back)
        if state is None:
            state = len(symbol) - 1
            if state and after[state - 1] > after[state]:
                state -= 1
            if not after[state] > -np.inf:
                return None
        for t in range(len(part) - 1, -1, -1):
            path[first + 1 + t] = state
            state -= int(back[t, state])
    path[0] = state
    return path


def ctc_path(blank: int):
    """(frames, targets) -> extended-state index per frame; ties keep the smaller step. Null without a
    path, without frames, or with a target outside the vocabulary."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def align(frames: pd.Series, targets: pd.Series) -> pd.Series:
        def one(f, t):
            wanted = np.asarray([] if t is None else t, float)  # a null target is NaN
            if f is None or t is None or not len(f) or np.isnan(wanted).any():
                return None
            return _path(np.stack([np.asarray(x, float) for x in f]), wanted.astype(int), blank)

        return pd.Series([one(f, t) for f, t in zip(frames, targets)], dtype=object)

    return align
