"""Operators on sample arrays: energy, quality, time-domain cues, augmentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoframe.functions.scalar import col, hash_bucket, let, mean, total

TINY = 1e-9


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def _decibel(amplitude: Column) -> Column:
    return 20.0 * F.log10(F.greatest(amplitude, F.lit(1e-10)))


def _power(xs: Column) -> Column:
    return mean(F.transform(xs, lambda x: x.cast("double") * x.cast("double")))


def frame_slices(samples: Column, frame: int, hop: int) -> Column:
    """Overlapping frames of a signal; empty when it is shorter than one frame."""
    n = F.size(samples)
    starts = F.sequence(F.lit(0), F.floor((n - frame) / hop).cast("int"))
    return F.when(n >= frame, F.transform(
        starts, lambda k: F.slice(samples, k * hop + 1, F.lit(frame)))).otherwise(
        F.array().cast("array<array<double>>"))


def frame_rms_db(samples: Column | str, rate: int = 16_000, frame_s: float = 0.025, hop_s: float = 0.010) -> Column:
    """RMS level in dB of overlapping frames."""
    frames = frame_slices(col(samples), int(frame_s * rate), int(hop_s * rate))
    return F.transform(frames, lambda f: _decibel(F.sqrt(_power(f))))


def energy_profile(samples: Column | str, rate: int = 16_000, frame_s: float = 0.02) -> Column:
    """RMS of adjoining frames; a short signal gives one zero."""
    size = max(1, int(frame_s * rate))
    frames = frame_slices(col(samples), size, size)
    return F.when(F.size(col(samples)) < size, F.array(F.lit(0.0))).otherwise(
        F.transform(frames, lambda f: F.sqrt(_power(f))))


def quality(samples: Column | str, speech: Column | str) -> Column:
    """struct(clipping, too_quiet, low_level, speech_level_dbfs, peak_dbfs)."""
    xs, region = col(samples), col(speech)
    region = F.when(F.size(region) > 0, region).otherwise(xs)
    clipped = F.size(F.filter(xs, lambda x: F.abs(x) >= 0.995))
    limit = F.greatest(F.lit(1), F.floor(0.001 * F.size(xs)))
    level = _decibel(F.sqrt(F.coalesce(_power(region), F.lit(0.0))))
    peak = F.coalesce(F.array_max(F.transform(xs, lambda x: F.abs(x).cast("double"))), F.lit(0.0))
    shown = F.round(level, 1)
    return F.struct(
        (clipped > limit).alias("clipping"), (level < -70.0).alias("too_quiet"),
        (shown < -40.0).alias("low_level"), shown.alias("speech_level_dbfs"),
        F.round(_decibel(peak), 1).alias("peak_dbfs"))


def _shifted_product(xs: Column, lag: Column) -> Column:
    """Sum of x[k] * x[k + lag]."""
    n = F.size(xs)
    pairs = F.zip_with(F.slice(xs, F.lit(1), n - lag), F.slice(xs, lag + 1, n - lag), lambda a, b: a * b)
    return total(pairs)


def time_features(samples: Column | str, rate: int = 16_000) -> Column:
    """struct of loudness, zero crossings, closure dip, burst cues and voicing."""
    xs = col(samples)
    n = F.size(xs)
    rms = F.sqrt(_power(xs) + TINY)
    loud = _clip(20.0 * F.log10(rms + TINY), -80.0, 0.0) / 80.0 + 1.0
    # the sign bit tells negative numbers; -0.0 is not told apart from 0.0
    flips = F.zip_with(
        F.slice(xs, F.lit(1), n - 1), F.slice(xs, F.lit(2), n - 1),
        lambda a, b: F.when((a < 0) != (b < 0), 1.0).otherwise(0.0))
    crossings = _clip(mean(flips) * (rate / 1000.0) / 16.0, 0.0, 1.0)
    frames = frame_slices(xs, int(0.010 * rate), int(0.005 * rate))

    def bursts(levels: Column) -> Column:
        low, high, mid = F.array_min(levels), F.array_max(levels), mean(levels) + TINY
        rises = F.zip_with(
            F.slice(levels, F.lit(1), F.size(levels) - 1), F.slice(levels, F.lit(2), F.size(levels) - 1),
            lambda a, b: b - a)
        sharp = F.when(F.size(levels) > 1, _clip(F.array_max(rises) / (mid + TINY) / 3.0, 0.0, 1.0))
        framed = lambda value: F.when(F.size(levels) > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
        return F.struct(
            framed(_clip(F.log10((low + TINY) / (mid + TINY)), -3.0, 0.0) / -3.0).alias("dip"),
            framed(sharp).alias("sharp"),
            framed(_clip(F.log10((high + TINY) / (low + TINY)), 0.0, 3.0) / 3.0).alias("contrast"))

    def periodicity(centred: Column) -> Column:
        base = _shifted_product(centred, F.lit(0)) + TINY
        lags = F.sequence(F.lit(rate // 400), F.lit(rate // 70 - 1))
        return _clip(F.array_max(F.transform(lags, lambda k: _shifted_product(centred, k))) / base, 0.0, 1.0)

    centred = let(mean(xs), lambda mu: F.transform(xs, lambda x: x - mu))
    voicing = F.when(n > rate // 70, let(centred, periodicity)).otherwise(0.5)
    return let(let(F.transform(frames, lambda f: F.sqrt(_power(f) + TINY)), bursts), lambda burst: F.struct(
        loud.alias("rms_db"), crossings.alias("zero_crossing"), burst["dip"].alias("closure_dip"),
        burst["sharp"].alias("burst_sharpness"), burst["contrast"].alias("burst_contrast"),
        voicing.alias("voicing")))


# -- augmentation ----------------------------------------------------------------------------


def _uniform(key: Column, seed: int, draw: str) -> Column:
    return (hash_bucket(F.concat_ws(":", F.lit(str(seed)), F.lit(draw), key.cast("string")), 1 << 31)
            + 0.5) / float(1 << 31)


def stretch(samples: Column, factor: Column) -> Column:
    """Speed change by linear interpolation at an unchanged length, padded with zeros."""
    def moved(m: Column) -> Column:
        n = F.size(samples)

        def value(k: Column) -> Column:
            at = k * (n - 1) / F.greatest(m - 1, F.lit(1))
            low = F.floor(at).cast("int")
            a = F.get(samples, low)
            b = F.coalesce(F.get(samples, low + 1), a)
            return F.when(k < m, a + (b - a) * (at - low)).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), n - 1), value)

    return let(F.floor(F.size(samples) / factor).cast("int"), moved)


def add_noise(samples: Column, key: Column, snr_db: Column, seed: int) -> Column:
    """Gaussian noise at a signal-to-noise ratio, drawn from hashes of key and position."""
    def noisy(xs: Column, spread: Column) -> Column:
        def value(x: Column, k: Column) -> Column:
            place = F.concat_ws("/", key.cast("string"), k.cast("string"))
            radius = F.sqrt(-2.0 * F.ln(_uniform(place, seed, "radius")))
            return x + spread * radius * F.cos(F.lit(6.283185307179586) * _uniform(place, seed, "angle"))

        return F.transform(xs, value)

    return let(samples, lambda xs: let(
        F.sqrt(_power(xs) + TINY) / F.pow(F.lit(10.0), snr_db / 20.0), lambda spread: noisy(xs, spread)))


def augment(samples: Column | str, key: Column | str, is_target: Column, seed: int = 42) -> Column:
    """Stretched and noisy copy of half of the non-target rows; the length is kept.

    All draws come from hashes of the row key, so a recomputed task gives the same row.
    """
    xs, k = col(samples), col(key)
    draw = lambda name: _uniform(k, seed, name)
    factor = F.when(draw("stretch?") < 0.6, 0.9 + 0.2 * draw("factor")).otherwise(1.0)
    moved = F.when(factor != 1.0, stretch(xs, factor)).otherwise(xs)
    loud = F.when(draw("noise?") < 0.6, add_noise(moved, k, 15.0 + 15.0 * draw("snr"), seed)).otherwise(moved)
    return F.when(~is_target & (draw("use?") < 0.5), loud).otherwise(xs)
