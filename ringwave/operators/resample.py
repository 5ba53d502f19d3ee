"""Band-limited resampling of whole records.

Records up to ``DIRECT`` samples are transformed in one array. Longer ones go through a chirp
transform whose power-of-two FFTs are split into rows and columns, so that no task ever holds more
than about the square root of the record.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwave.functions.spectral import COMPLEX_ARRAYS
from ringwave.operators import align, blocks

DIRECT = 1 << 20


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _resample_direct(vals: pd.Series, num: pd.Series) -> pd.Series:
    out = []
    for v, m in zip(vals, num):
        v, m = np.asarray(v, dtype=float), int(m)
        n = len(v)
        keep = min(n, m)
        spec = np.fft.rfft(v)
        half = np.zeros(m // 2 + 1, dtype=complex)
        half[: keep // 2 + 1] = spec[: keep // 2 + 1]
        if keep % 2 == 0 and m != n:
            half[keep // 2] *= 2.0 if m < n else 0.5
        out.append(np.fft.irfft(half, m) * (m / n))
    return pd.Series(out)


@F.pandas_udf(COMPLEX_ARRAYS)
def _fft_line(at: pd.Series, re: pd.Series, im: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Transform of a line of ``n`` places of which those ``at`` are given and the others zero."""
    out = []
    for place, a, b, size in zip(at, re, im, n):
        line = np.zeros(int(size), dtype=complex)
        line[np.asarray(place, dtype=np.int64)] = np.asarray(a) + 1j * np.asarray(b)
        out.append(np.fft.fft(line))
    return pd.DataFrame({"re": [x.real for x in out], "im": [x.imag for x in out]})


def _lines(df: DataFrame, keys: Sequence[str], line: Column, pos: Column, length: Column) -> DataFrame:
    """Transform every line of a two-dimensional layout; missing positions are zero."""
    g = df.select(*keys, line.alias("_l"), pos.cast("int").alias("_p"), "re", "im", length.cast("int").alias("_n"))
    g = g.groupBy(*keys, "_l", "_n").agg(F.collect_list(F.struct("_p", "re", "im")).alias("_r"))
    g = g.select(*keys, "_l", _fft_line("_r._p", "_r.re", "_r.im", "_n").alias("z"))
    return g.select(*keys, "_l", F.posexplode(F.arrays_zip("z.re", "z.im")).alias("_k", "c")).select(
        *keys, "_l", "_k", F.col("c.re").alias("re"), F.col("c.im").alias("im"))


def _turn(df: DataFrame, angle: Column) -> DataFrame:
    c, s = F.cos(angle), F.sin(angle)
    return df.withColumns({"re": F.col("re") * c - F.col("im") * s, "im": F.col("re") * s + F.col("im") * c})


def split_fft(df: DataFrame, keys: Sequence[str], size: str, pos: str = "n") -> DataFrame:
    """Forward FFT of a power-of-two ``size`` column: columns, twiddle, rows. Output position ``k``."""
    rows = F.pow(F.lit(2.0), F.floor(F.round(F.log2(F.col(size))) / 2)).cast("long")
    d = df.withColumn("_n1", rows).withColumn("_n2", (F.col(size) / F.col("_n1")).cast("long"))
    group = [*keys, size, "_n1", "_n2"]
    step = _lines(d, group, F.col(pos) % F.col("_n2"), F.floor(F.col(pos) / F.col("_n2")), F.col("_n1"))
    phase = -2.0 * np.pi * ((F.col("_l") * F.col("_k")) % F.col(size)) / F.col(size)
    step = _turn(step, phase)
    out = _lines(step.withColumnsRenamed({"_l": "_col", "_k": "_row"}), group, F.col("_row"), F.col("_col"), F.col("_n2"))
    return out.select(*keys, size, (F.col("_l") + F.col("_n1") * F.col("_k")).alias("k"), "re", "im")


def _chirp_angle(pos: Column, n: Column) -> Column:
    p = pos.cast("long")
    return np.pi * ((p * p) % (2 * n)) / n


def _range_rows(sizes: DataFrame, keys: Sequence[str], length: Column) -> DataFrame:
    """0..length-1 per key, generated in pieces so that no row holds a whole range."""
    piece = 1 << 16
    d = sizes.withColumn("_len", length).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_len") - 1) / piece))))
    top = F.least(F.col("_len"), (F.col("_q") + 1) * piece) - 1
    return d.repartition(*keys, "_q").withColumn("n", F.explode(F.sequence(F.col("_q") * piece, top))).drop("_q", "_len")


def chirp_dft(df: DataFrame, keys: Sequence[str], length: str, pos: str = "n", sign: int = -1) -> DataFrame:
    """DFT of any ``length`` per key (``sign`` -1 forward, +1 backward, unscaled). Output position ``k``.

    The chirp depends on the length alone and is transformed once for all records of a length.
    """
    keys = list(keys)
    n = F.col(length)
    size = F.pow(F.lit(2.0), F.ceil(F.log2(2 * n - 1))).cast("long")
    group = [*keys, length, "_m"]
    a = _turn(df.select(*keys, F.col(length).cast("long"), F.col(pos).cast("long").alias("n"), "re", "im"), sign * _chirp_angle(F.col(pos), n)).withColumn("_m", size)
    alike = [length, "_m"]
    chirp = _range_rows(a.select(*alike).distinct(), alike, n).withColumn("_t", -sign * _chirp_angle(F.col("n"), n))
    chirp = chirp.select(*alike, F.explode(F.when(F.col("n") > 0, F.array("n", F.col("_m") - F.col("n"))).otherwise(F.array("n"))).alias("n"),
                         F.cos("_t").alias("re"), F.sin("_t").alias("im"))
    inner = [*keys, length]
    fa, fb = split_fft(a, inner, "_m"), split_fft(chirp, [length], "_m")
    prod = fa.join(fb.select(*alike, "k", F.col("re").alias("br"), F.col("im").alias("bi")), [*alike, "k"]).select(
        *group, F.col("k").alias("n"), (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"),
        (-(F.col("re") * F.col("bi") + F.col("im") * F.col("br"))).alias("im"))
    conv = split_fft(prod, inner, "_m").where(F.col("k") < n)
    conv = conv.withColumns({"re": F.col("re") / F.col("_m"), "im": -F.col("im") / F.col("_m")})
    return _turn(conv, sign * _chirp_angle(F.col("k"), n)).select(*keys, length, "k", "re", "im")


def _resample_long(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    spec = chirp_dft(d.select(*keys, "n_in", "num", "t0", "dt", F.col("i").alias("n"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im")),
                     [*keys, "num", "t0", "dt"], "n_in")
    keep = F.least("n_in", "num")
    nyq = (keep % 2 == 0) & (F.col("k") == keep / 2) & (F.col("num") != F.col("n_in"))
    scale = F.when(nyq, F.when(F.col("num") < F.col("n_in"), 2.0).otherwise(0.5)).otherwise(1.0)
    half = spec.where(F.col("k") <= F.floor(keep / 2)).withColumns({"re": F.col("re") * scale, "im": F.col("im") * scale})
    edge = (F.col("num") % 2 == 0) & (F.col("k") == F.col("num") / 2)
    alone = (F.col("k") == 0) | edge
    both = F.array(F.struct(F.col("k").alias("n"), "re", F.when(alone, 0.0).otherwise(F.col("im")).alias("im")),
                   F.when(~alone, F.struct((F.col("num") - F.col("k")).alias("n"), "re", (-F.col("im")).alias("im"))))
    full = half.select(*keys, "n_in", "num", "t0", "dt", F.inline(F.array_compact(both)))
    y = chirp_dft(full, [*keys, "n_in", "t0", "dt"], "num", sign=1)
    return y.select(*keys, "n_in", "num", "t0", "dt", F.col("k").alias("i"), (F.col("re") / F.col("n_in")).alias("value"))


def resample(samples: DataFrame, sample_rate: float, *, t_range: tuple[float, float] | None = None,
             keys: Sequence[str] = ("shot", "channel"), direct_limit: int | None = None) -> DataFrame:
    """Trim, then Fourier-resample each record to ``int(span * rate)`` evenly spaced samples."""
    keys = list(keys)
    limit = DIRECT if direct_limit is None else direct_limit
    d = samples if t_range is None else align.reindex(align.trim(samples, *t_range), keys)
    meta = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in"), F.floor((F.max("t_s") - F.min("t_s")) * sample_rate).cast("long").alias("num"),
        F.min("t_s").alias("t0"), (F.min(F.when(F.col("i") == 1, F.col("t_s"))) - F.min("t_s")).alias("dt"))
    d = d.join(meta, keys)
    group = [*keys, "n_in", "num", "t0", "dt"]
    short = blocks.pack(d.where(F.col("n_in") <= limit), group, "i", ["value"], limit)
    short = short.select(*group, _resample_direct("rows.value", "num").alias("y")).select(*group, F.posexplode("y").alias("i", "value"))
    long_ = _resample_long(d.where(F.col("n_in") > limit), keys)
    both = short.withColumn("i", F.col("i").cast("long")).unionByName(long_.select(*group, "i", "value"))
    return both.select(*keys, "i", (F.col("t0") + F.col("i") * F.col("dt") * F.col("n_in") / F.col("num")).alias("t_s"), "value")


def block_average(samples: DataFrame, sample_rate: float, keys: Sequence[str] = ("shot", "channel"), t: str = "t_s") -> DataFrame:
    """Cheap alternative for very long archives: mean per output interval (not band-limited)."""
    return samples.groupBy(*keys, F.floor(F.col(t) * sample_rate).cast("long").alias("i")).agg(F.avg("value").alias("value")) \
        .withColumn(t, F.col("i") / sample_rate)
