"""Spectral helpers: tapers, transform lengths, error formulas and the Arrow transform."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwave.functions.scalar import _c

SMOOTH_PRIMES = (2, 3, 5, 7, 11)  # fixed: transform lengths have no larger prime factor


def fast_length(n: int) -> int:
    """Smallest length >= n whose prime factors are all small."""
    n = max(1, int(n))
    while True:
        rest = n
        for p in SMOOTH_PRIMES:
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


@F.pandas_udf(T.LongType())
def fast_length_udf(n: pd.Series) -> pd.Series:
    return n.map(fast_length)


def hann(n: int) -> np.ndarray:
    """Periodic Hann taper."""
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def hann_power(n: int) -> float:
    return float(np.sum(hann(n) ** 2))


def hann_col(j, n) -> Column:
    return 0.5 - 0.5 * F.cos(2.0 * math.pi * _c(j) / _c(n))


def welch_segments(n, nperseg) -> Column:
    """Number of half-overlapping segments in ``n`` samples."""
    size = F.greatest(F.lit(1), F.least(_c(nperseg), _c(n)))
    step = F.greatest(F.lit(1), size - F.floor(size / 2))
    return F.greatest(F.lit(1), 1 + F.floor((_c(n) - size) / step)).cast("long")


def phase_error(coherence, segments) -> Column:
    """1-sigma cross-phase error in degrees, at most 180."""
    g = _visibility(coherence)
    rad = F.sqrt(F.greatest(1.0 - g * g, F.lit(0.0))) / (g * F.sqrt(2.0 * F.greatest(_c(segments), F.lit(1))))
    return F.least(F.degrees(rad), F.lit(180.0))


def amplitude_error(coherence, power, segments) -> Column:
    return _c(power) / (_visibility(coherence) * F.sqrt(F.greatest(_c(segments), F.lit(1))))


def _visibility(coherence) -> Column:
    g = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(coherence))))
    return F.greatest(g, F.lit(1e-3))


def mode_limit(delta_phi) -> Column:
    """Largest |n| a probe pair ``delta_phi`` degrees apart can tell."""
    return F.floor(F.ceil(180.0 / F.abs(_c(delta_phi)) - 0.5) * 2 / 2).cast("int")


_DOUBLES = T.ArrayType(T.DoubleType())
COMPLEX_ARRAYS = T.StructType([T.StructField("re", _DOUBLES), T.StructField("im", _DOUBLES)])


PIECE = 1 << 17  # numbers a task's Python hands back at once


@F.pandas_udf(COMPLEX_ARRAYS)
def _frame_transform(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    tapers: dict[int, np.ndarray] = {}
    for batch in batches:
        re, im, held = [], [], 0
        for v, own, n, h, a, b, is_first in zip(*batch):
            v, n, h = np.asarray(v, dtype=float), int(n), int(h)
            if n not in tapers:
                tapers[n] = hann(n)
            if len(v) >= n:
                count = min(-(-int(own) // h), (len(v) - n) // h + 1)
                frames = np.lib.stride_tricks.sliding_window_view(v, n)[::h][:count]
                frames = frames - frames.mean(axis=1, keepdims=True)
            elif is_first:  # a record shorter than one frame: zero padded, mean of the real part removed
                frames = np.zeros((1, n))
                frames[0, : len(v)] = v - v.mean()
            else:
                frames = np.zeros((0, n))
            spec = np.fft.rfft(frames * tapers[n], axis=1)[:, int(a): int(b) + 1]
            re.append(spec.real.ravel())
            im.append(spec.imag.ravel())
            held += 2 * spec.size
            if held >= PIECE:
                yield pd.DataFrame({"re": re, "im": im})
                re, im, held = [], [], 0
        if re:
            yield pd.DataFrame({"re": re, "im": im})


def frame_transform(vals, span, n_fft, hop, k_lo, k_hi, first) -> Column:
    """Taper and transform all frames that start inside a packed block, keeping bins k_lo..k_hi.

    Spectra are larger than the samples they come from, so they leave a batch in pieces. The optimiser takes the
    transform for one with changing results: it would push a filter on the spectra below and transform twice.
    """
    return _frame_transform.asNondeterministic()(vals, span, n_fft, hop, k_lo, k_hi, first)
