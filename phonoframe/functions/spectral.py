"""Spectral cues of a signal: the one vectorised Arrow UDF of the library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-9
COLUMNS = ["sibilance", "centroid", "rolloff", "flatness"]


def _cues(signal: np.ndarray, rate: float) -> tuple[float, float, float, float]:
    if signal.size == 0:
        return (0.0, 0.0, 0.0, 0.0)
    power = np.abs(np.fft.rfft(signal * np.hanning(signal.size))) ** 2 + FLOOR
    hz = np.fft.rfftfreq(signal.size, d=1.0 / rate)
    whole = power.sum()

    def band(low: float, high: float) -> float:
        return power[(hz >= low) & (hz <= high)].sum() + FLOOR

    contrast = np.log10(band(5000.0, 8000.0) / band(1000.0, 3500.0))
    edge = min(int(np.searchsorted(np.cumsum(power), 0.85 * whole)), hz.size - 1)
    return (
        float(np.clip(contrast, -2.5, 1.5) / 4.0 + 0.625),
        float(np.clip((hz * power).sum() / whole / 8000.0, 0.0, 1.0)),
        float(np.clip(hz[edge] / 8000.0, 0.0, 1.0)),
        float(np.clip(np.exp(np.log(power).mean()) / power.mean(), 0.0, 1.0)),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in COLUMNS]))
def spectral_features(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    rows = [_cues(np.asarray(s, dtype=np.float64), float(r)) for s, r in zip(samples, rate)]
    return pd.DataFrame(rows, columns=COLUMNS)
