"""Warping distance of two contours, Arrow-batched: the cost table is filled along its
anti-diagonals, so each step is one vector operation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _distance(a: np.ndarray, b: np.ndarray) -> float | None:
    if a.size < 3 or b.size < 3:
        return None
    n, m = a.size, b.size
    older = np.full(n + 1, np.inf)
    newer = np.full(n + 1, np.inf)
    older[0] = 0.0
    for d in range(2, n + m + 1):
        rows = np.arange(max(1, d - m), min(n, d - 1) + 1)
        gap = a[rows - 1] - b[d - rows - 1]
        here = np.full(n + 1, np.inf)
        here[rows] = gap * gap + np.minimum(np.minimum(newer[rows - 1], newer[rows]), older[rows - 1])
        older, newer = newer, here
    return float(newer[n] / (n + m))


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Squared-cost warping distance over the summed lengths; null under three frames."""
    values = [
        None if x is None or y is None else _distance(np.asarray(x, dtype=float), np.asarray(y, dtype=float))
        for x, y in zip(a, b)
    ]
    return pd.Series(values, dtype="float64")
