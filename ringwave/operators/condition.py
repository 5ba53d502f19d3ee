"""Signal conditioning: resampling, integration, causal filters, detrending, noise removal."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwave.operators import align, blocks
from ringwave.operators.spectra import _col

KEYS = ("shot", "channel")
TIME_BLOCK = 2048  # time steps per matrix block


# ---- integration -----------------------------------------------------------------------
def box_taps(width: float) -> np.ndarray:
    return np.full(int(width), 1.0 / int(width))


def window_points(window: float, dt) -> Column:
    """Odd number of samples in a running-average window."""
    return (F.rint(window / _col(dt) / 2.0) * 2 + 1).cast("long")


def remove_mean(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    mean = samples.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return blocks.join_small(samples, mean, list(keys)).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def remove_running_mean(samples: DataFrame, points, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Subtract a centred running average of an odd number of samples, mirrored at the ends."""
    half = F.floor((_col(points) - 1) / 2).cast("long")
    run = blocks.filtered(samples, keys, "i", {"_m": value}, box_taps, "reflect", param=points, before=half, after=half, carry=samples.columns)
    return run.withColumn(value, F.col(value) - F.col("_m")).select(*samples.columns)


def cumulative_trapezoid(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", t: str = "t_s", out: str = "integral",
                         dx=None) -> DataFrame:
    """Running trapezoid integral starting at zero, over ``t`` or an even step ``dx``."""
    d = blocks.with_previous(samples, keys, "i", [value, t])
    step = F.col(t) - F.col(f"prev_{t}") if dx is None else _col(dx)
    d = d.withColumn("_inc", (F.col(value) + F.col(f"prev_{value}")) / 2.0 * step)
    return blocks.running_sum(d, keys, "i", "_inc", out).drop("_inc", f"prev_{value}", f"prev_{t}")


def integrate(samples: DataFrame, *, highpass_points=None, remove: bool = True, keys: Sequence[str] = KEYS, t: str = "t_s") -> DataFrame:
    """dB/dt -> B after removing the mean, or a running mean of ``highpass_points`` samples."""
    d = samples
    if remove:
        d = remove_mean(samples, keys) if highpass_points is None else remove_running_mean(samples, highpass_points, keys)
    d = cumulative_trapezoid(d, keys, t=t)
    return d.withColumn("value", F.col("integral")).drop("integral")


# ---- causal filters ----------------------------------------------------------------------
def causal_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Gaussian weights of lags up to ``truncate`` sigma (nearest whole lag), oldest first, summing to 1.

    A width that reaches no lag, or is no positive number, leaves the present sample alone.
    """
    reach = math.floor(truncate * sigma + 0.5) if 0 < sigma < math.inf else 0
    if not reach:
        return np.ones(1)
    lag = np.arange(reach, -1, -1.0)
    density = np.exp(-(lag**2) / (2.0 * sigma**2))
    return density / density.sum()


def causal_gaussian(samples: DataFrame, sigma, keys: Sequence[str] = KEYS, value: str = "value", out: str | None = None) -> DataFrame:
    """Gaussian average of present and past samples only; ``sigma`` in samples, a number or a column."""
    s = _col(sigma).cast("double")
    radius = F.when(s > 0, F.floor(4.0 * s + 0.5)).otherwise(0).cast("long")
    run = blocks.filtered(samples, keys, "i", {"_y": value}, causal_taps, "first", param=s, before=radius, carry=samples.columns)
    return run.withColumn(out or value, F.col("_y")).drop("_y")


def filter_step(n, dt, f_high) -> Column:
    """Automatic thinning before a low-pass: bounded by the band and by 300 remaining samples."""
    nyquist = 0.5 / _col(dt)
    by_band = F.greatest(F.lit(1), F.floor(nyquist / _col(f_high)))
    return F.least(by_band, F.ceil(_col(n) / 300.0)).cast("long")


def band_filter(samples: DataFrame, clock: DataFrame, f_low: float, f_high: float) -> DataFrame:
    """Causal low-, high- or band-pass with automatic thinning, chosen per recording.

    ``clock``: shot, n (samples per channel) and dt.
    """
    nyq = 0.5 / F.col("dt")
    active = F.lit(f_low > 0) | (nyq > f_high)
    d = blocks.join_small(samples, clock.select("shot", "n", "dt"), "shot")
    d = d.withColumn("_step", F.when(active, filter_step("n", "dt", f_high)).otherwise(1))
    d = align.decimate(d, "_step").withColumn("dt", F.col("dt") * F.col("_step"))
    highpass = F.lit(f_high) >= nyq_before("dt", "_step")
    s_hi = F.when(active & ~highpass, 0.25 / (F.col("dt") * f_high)).otherwise(0.0)
    d = d.withColumn("_s", s_hi)
    d = causal_gaussian(d, "_s").drop("_s")
    if f_low > 0:
        d = d.withColumn("_s", 0.25 / (F.col("dt") * f_low))
        d = causal_gaussian(d, "_s", out="_slow").withColumn("value", F.col("value") - F.col("_slow")).drop("_slow", "_s")
    return d.drop("n", "_step")


def nyq_before(dt: str, step: str) -> Column:
    """Nyquist frequency of the clock before thinning."""
    return 0.5 / (F.col(dt) / F.col(step))


# ---- detrending --------------------------------------------------------------------------
def in_bands(t: str, bands: Sequence[tuple[float, float]]) -> Column:
    cond = F.lit(False)
    for a, b in bands:
        cond = cond | F.col(t).between(_col(a), _col(b))
    return cond


def detrend(samples: DataFrame, kind: str, bands: Sequence[tuple], keys: Sequence[str] = KEYS, t: str = "t_s") -> DataFrame:
    """Remove a baseline, a line fitted to bands, or the line through a band's finite end points."""
    if kind == "none":
        return samples
    v, cond = F.col("value").cast("double"), in_bands(t, bands)
    if kind == "baseline":
        trend = samples.groupBy(*keys).agg(F.avg(F.when(cond, v)).alias("_b")).withColumn("_a", F.lit(0.0))
    elif kind == "linear":
        y, x = F.when(cond, v), F.when(cond, F.col(t))
        trend = samples.groupBy(*keys).agg(F.regr_slope(y, x).alias("_a"), F.regr_intercept(y, x).alias("_b"))
    elif kind == "endpoints":
        lo, hi = bands[0][0], bands[-1][1]
        ok = F.when(F.col(t).between(_col(lo), _col(hi)) & ~F.isnan(v) & (F.abs(v) < float("inf")), F.col(t))
        ends = samples.groupBy(*keys).agg(
            F.min(ok).alias("_t0"), F.max(ok).alias("_t1"), F.min_by(v, ok).alias("_v0"), F.max_by(v, ok).alias("_v1"))
        slope = (F.col("_v1") - F.col("_v0")) / (F.col("_t1") - F.col("_t0"))
        two = F.col("_t1") > F.col("_t0")
        trend = ends.select(
            *keys, F.when(two, slope).otherwise(0.0).alias("_a"),
            F.when(two, F.col("_v0") - slope * F.col("_t0")).otherwise(0.0).alias("_b"))
    else:
        raise ValueError("detrend kind must be none, baseline, linear or endpoints")
    return blocks.join_small(samples, trend, list(keys)).withColumn("value", v - (F.col("_a") * F.col(t) + F.col("_b"))).drop("_a", "_b")


# ---- noise removal by singular values --------------------------------------------------------
_GRAM = T.StructType([T.StructField("c1", T.StringType()), T.StructField("c2", T.StringType()), T.StructField("g", T.DoubleType())])


def gram(samples: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Channel x channel Gram matrix: one small matrix per time block, summed over blocks.

    Pairs are never formed per time step; a block of time steps becomes a dense matrix product and
    only its upper triangle is shuffled.
    """
    keys = list(keys)
    d = samples.select(*keys, F.col("channel").cast("string").alias("channel"), "i", F.col("value").cast("double").alias("value"))
    d = d.withColumn("_tb", F.floor(F.col("i") / TIME_BLOCK))
    key_fields = [d.schema[k] for k in keys]

    def block_product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="channel", columns="i", values="value").fillna(0.0).sort_index()
        g = m.values @ m.values.T
        a, b = np.triu_indices(len(m))
        names = m.index.to_numpy()
        out = pd.DataFrame({"c1": names[a], "c2": names[b], "g": g[a, b]})
        for name, val in zip(keys, key):
            out.insert(0, name, val)
        return out[[*keys, "c1", "c2", "g"]]

    schema = T.StructType([*key_fields, *_GRAM.fields])
    return d.groupBy(*keys, "_tb").applyInPandas(block_product, schema).groupBy(*keys, "c1", "c2").agg(F.sum("g").alias("g"))


def energy_cut(s: np.ndarray, energy: float, n_channels: int) -> int:
    """Number of singular values whose summed energy first exceeds the share ``energy``.

    One more is kept if, of the two values that follow, the second has over half the energy of the
    first: such pairs belong together. All channels when the share is never exceeded before the last.
    """
    power = np.square(s)
    if not power.any():
        return n_channels
    needed = 1 + int(np.searchsorted(np.cumsum(power) / power.sum(), energy, side="right"))
    if needed >= len(s):
        return n_channels
    following = power[needed : needed + 2]
    return needed + int(len(following) == 2 and 2 * following[1] > following[0])


def singular_basis(gram_rows: DataFrame, lengths: DataFrame, energy: float, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Per recording: singular values, energy fractions, kept count and the projector.

    ``lengths``: keys and ``n_time``. Works on one P x P matrix per recording, P = channels.
    """
    keys = list(keys)
    d = gram_rows.join(lengths.select(*keys, F.col("n_time").cast("long").alias("n_time")), keys)
    key_fields = [d.schema[k] for k in keys]

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.array(sorted(set(pdf.c1) | set(pdf.c2)))
        at = {c: j for j, c in enumerate(names)}
        g = np.zeros((len(names), len(names)))
        a, b = pdf.c1.map(at).to_numpy(), pdf.c2.map(at).to_numpy()
        g[a, b] = pdf.g
        g[b, a] = pdf.g
        n_time = int(pdf.n_time.iloc[0])
        val, vec = np.linalg.eigh(g / (len(names) * n_time))
        order = np.argsort(val)[::-1]
        s = np.sqrt(np.clip(val[order], 0.0, None))[: min(len(names), n_time)]
        u = vec[:, order][:, : len(s)]
        cut = min(energy_cut(s, energy, len(names)), len(s))
        proj = u[:, :cut] @ u[:, :cut].T if energy < 1.0 else np.eye(len(names))
        frac = np.cumsum(s**2) / max(float(np.sum(s**2)), 1e-300)
        row = dict(zip(keys, key)) | {"channels": list(names), "svals": s, "energy_fraction": frac, "rank": cut, "projector": proj.ravel()}
        return pd.DataFrame([row])

    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*key_fields, T.StructField("channels", T.ArrayType(T.StringType())), T.StructField("svals", doubles),
                           T.StructField("energy_fraction", doubles), T.StructField("rank", T.IntegerType()),
                           T.StructField("projector", doubles)])
    return d.groupBy(*keys).applyInPandas(solve, schema)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _project(names: pd.Series, idx: pd.Series, vals: pd.Series, channels: pd.Series, proj: pd.Series) -> pd.Series:
    out = []
    for n, i, v, ch, p in zip(names, idx, vals, channels, proj):
        order = {c: j for j, c in enumerate(ch)}
        rows = np.array([order[c] for c in n])
        steps, cols = np.unique(np.asarray(i), return_inverse=True)
        m = np.zeros((len(ch), len(steps)))
        m[rows, cols] = np.asarray(v, dtype=float)
        out.append((np.asarray(p).reshape(len(ch), len(ch)) @ m)[rows, cols])
    return pd.Series(out)


def project(samples: DataFrame, basis: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Rebuild the samples from the kept singular vectors, one time block per matrix product."""
    keys = list(keys)
    d = samples.select(*keys, F.col("channel").cast("string").alias("channel"), "i", "t_s", F.col("value").cast("double").alias("value"))
    packed = d.groupBy(*keys, F.floor(F.col("i") / TIME_BLOCK).alias("_tb")).agg(F.collect_list(F.struct("channel", "i", "t_s", "value")).alias("r"))
    done = blocks.join_small(packed, basis.select(*keys, "channels", "projector"), keys).select(
        *keys, "r", _project("r.channel", "r.i", "r.value", "channels", "projector").alias("y"))
    return done.select(*keys, F.inline(F.arrays_zip(F.col("r.channel").alias("channel"), F.col("r.i").alias("i"), F.col("r.t_s").alias("t_s"), F.col("y").alias("value"))))


def svd_condition(samples: DataFrame, energy: float, keys: Sequence[str] = ("shot",)) -> tuple[DataFrame, DataFrame]:
    """(cleaned samples, basis table); ``energy >= 1`` leaves the samples unchanged."""
    keys = list(keys)
    lengths = samples.groupBy(*keys).agg((F.max("i") + 1).alias("n_time"))
    basis = singular_basis(gram(samples, keys), lengths, energy, keys)
    return (samples if energy >= 1.0 else project(samples, basis, keys)), basis
