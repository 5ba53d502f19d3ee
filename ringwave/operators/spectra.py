"""Short-time spectra, cross spectra, coherence, gates and smoothing."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwave.functions import spectral as S
from ringwave.operators import blocks

TINY = 1e-30


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


# ---- layout --------------------------------------------------------------------------
def median_step(samples: DataFrame, keys: Sequence[str] = ("shot",), idx: str = "i", axis: str = "t_s") -> DataFrame:
    """Median spacing of an axis per key; a key with fewer than two points gets NaN."""
    keys = list(keys)
    steps = (
        blocks.with_previous(samples.select(*keys, idx, axis), keys, idx, [axis])
        .select(*keys, F.abs(F.col(axis) - F.col(f"prev_{axis}")).alias("step"))
    )
    med = blocks.exact_percentile(steps, keys, "step", 0.5, "dt")
    return samples.select(*keys).distinct().join(med, keys, "left").withColumn("dt", F.coalesce("dt", F.lit(math.nan)))


def layout(clock: DataFrame, slice_duration: float, max_columns: int | None = None) -> DataFrame:
    """Frame length, hop and column count per recording.

    ``clock`` has one row per recording with ``n`` samples and step ``dt`` (s). The hop is half a
    frame and grows when that would give more than ``max_columns`` columns.
    """
    n_fft = F.greatest(F.lit(8).cast("long"), S.fast_length_udf(F.rint(slice_duration / F.col("dt")).cast("long")))
    d = clock.withColumn("n_fft", n_fft)
    natural = F.greatest(F.lit(1), F.floor(F.col("n_fft") / 2))
    columns = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("n_fft")) / natural) + 1)
    hop = natural
    if max_columns is not None:
        grown = F.greatest(natural, F.floor((F.col("n") - F.col("n_fft")) / max(1, max_columns - 1)))
        hop = F.when(columns > max_columns, grown).otherwise(natural)
    return d.withColumn("hop", hop.cast("long")).withColumn(
        "n_columns", F.greatest(F.lit(1), F.floor((F.col("n") - F.col("n_fft")) / F.col("hop")) + 1).cast("long")
    )


def frame_times(samples: DataFrame, n_fft, hop, dt, keys: Sequence[str] = ("shot",), axis: str = "t_s") -> DataFrame:
    """Centre time of each frame, from the sample the frame starts at (one channel per key)."""
    start = samples.where(F.col("i") % _col(hop) == 0)
    return start.select(
        *keys, F.floor(F.col("i") / _col(hop)).cast("long").alias("frame"),
        (F.col(axis) + _col(n_fft) / 2.0 * _col(dt)).alias("t_s"),
    )


# ---- transforms ------------------------------------------------------------------------
def explode_frames(samples: DataFrame, n_fft, hop) -> DataFrame:
    """Each sample once per frame that covers it, with its position ``j`` in the frame."""
    n, h = _col(n_fft), _col(hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - n + 1) / h))
    last = F.floor(F.col("i") / h)
    return (
        samples.where(first <= last)
        .withColumn("frame", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("j", F.col("i") - F.col("frame") * h)
    )


def stft(
    samples: DataFrame, n_fft, hop, k_lo=0, k_hi=None, *, keys: Sequence[str] = ("shot", "channel"), value: str = "value",
) -> DataFrame:
    """:func:`stft_frames` with one row per bin."""
    d = stft_frames(samples, n_fft, hop, k_lo, k_hi, keys=keys, value=value)
    d = d.select(*keys, "frame", "k_lo", F.posexplode(F.arrays_zip("re", "im")).alias("_p", "z"))
    return d.select(*keys, "frame", (F.col("k_lo") + F.col("_p")).cast("int").alias("k"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def stft_frames(
    samples: DataFrame, n_fft, hop, k_lo=0, k_hi=None, *, keys: Sequence[str] = ("shot", "channel"), value: str = "value",
) -> DataFrame:
    """Hann short-time spectrum of every (key, frame), mean removed per frame; bins as arrays ``re``, ``im``.

    Samples are packed into blocks of many frames plus one frame of overlap, so that only a few
    percent of the samples are shuffled twice even though frames overlap by half. Only bins
    ``k_lo..k_hi`` leave the transform. ``n_fft``, ``hop`` and the band may be columns that are
    constant per key.
    """
    keys = list(keys)
    n, h, lo = _col(n_fft), _col(hop), _col(k_lo)
    hi = F.floor(n / 2) if k_hi is None else F.least(_col(k_hi), F.floor(n / 2))
    d = samples.select(
        *keys, "i", value, n.cast("long").alias("_n"), h.cast("long").alias("_h"),
        lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"),
    )
    group = [*keys, "_n", "_h", "_lo", "_hi"]
    per_block = F.greatest(F.lit(1), F.floor(F.lit(blocks.BLOCK) / F.col("_h"))) * F.col("_h")
    packed = blocks.pack(d, group, "i", [value], per_block, right=F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    width = F.col("_hi") - F.col("_lo") + 1
    spec = S.frame_transform(F.col(f"rows.{value}"), "len", "_n", "_h", "_lo", "_hi", F.col("blk") == 0)
    at = F.col("_p") * width + 1
    return (
        packed.select(*group, "start", spec.alias("s"))
        .where(F.size("s.re") > 0)
        .select(*group, "start", "s", F.explode(F.sequence(F.lit(0), (F.size("s.re") / width - 1).cast("int"))).alias("_p"))
        .select(
            *keys, (F.col("start") / F.col("_h") + F.col("_p")).cast("long").alias("frame"), F.col("_lo").alias("k_lo"),
            F.slice("s.re", at.cast("int"), width.cast("int")).alias("re"), F.slice("s.im", at.cast("int"), width.cast("int")).alias("im"),
        )
    )


def twiddle_sums(j: Column, v: Column, n_fft: int, ks: Sequence[int]) -> list[Column]:
    """Aggregates from which the tapered, mean-free spectrum at bins ``ks`` follows."""
    w = S.hann_col(j, n_fft)
    out = [F.count(F.lit(1)).alias("_cnt"), F.sum(v).alias("_sum")]
    for k in ks:
        angle = 2.0 * math.pi * ((k * j) % n_fft) / n_fft
        c, s = w * F.cos(angle), w * F.sin(angle)
        out += [F.sum(v * c).alias(f"_vc{k}"), F.sum(c).alias(f"_c{k}"), F.sum(v * s).alias(f"_vs{k}"), F.sum(s).alias(f"_s{k}")]
    return out


def twiddle_rows(ks: Sequence[int]) -> Column:
    """Array of (k, re, im) made from :func:`twiddle_sums`."""
    mean = F.col("_sum") / F.col("_cnt")
    return F.array(*[
        F.struct(
            F.lit(int(k)).alias("k"),
            (F.col(f"_vc{k}") - mean * F.col(f"_c{k}")).alias("re"),
            (-(F.col(f"_vs{k}") - mean * F.col(f"_s{k}"))).alias("im"),
        ) for k in ks
    ])


def stft_band(samples: DataFrame, n_fft: int, hop: int, ks: Sequence[int], keys: Sequence[str] = ("shot", "channel"),
              value: str = "value") -> DataFrame:
    """The same spectrum for a narrow band as one JVM aggregation without any Python."""
    keys = list(keys)
    framed = explode_frames(samples.select(*keys, "i", value), n_fft, hop)
    sums = framed.groupBy(*keys, "frame").agg(*twiddle_sums(F.col("j"), F.col(value).cast("double"), n_fft, ks))
    whole = sums.where((F.col("_cnt") == n_fft) | (F.col("frame") == 0))
    return whole.select(*keys, "frame", F.inline(twiddle_rows(ks)))


# ---- two-probe analysis ---------------------------------------------------------------
def pair_products(spectra: DataFrame, pairs: DataFrame, *, pair_keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Cross and auto products of each listed probe pair per (recording, frame, bin).

    ``pairs`` has ``ch1, ch2`` and optionally ``delta_phi`` per recording. cross = conj(S2) * S1.
    """
    pk = list(pair_keys)
    imaginary = F.col("r2") * F.col("i1") - F.col("i2") * F.col("r1")
    extra = [c for c in pairs.columns if c not in (*pk, "ch1", "ch2")]
    one = spectra.select(*pk, F.col("channel").alias("ch1"), "frame", "k", F.col("re").alias("r1"), F.col("im").alias("i1"))
    two = spectra.select(*pk, F.col("channel").alias("ch2"), "frame", "k", F.col("re").alias("r2"), F.col("im").alias("i2"))
    return (
        one.join(pairs, [*pk, "ch1"]).join(two, [*pk, "ch2", "frame", "k"])
        .select(
            *pk, "ch1", "ch2", *extra, "frame", "k",
            (F.col("r2") * F.col("r1") + F.col("i2") * F.col("i1")).alias("xre"),
            F.when(imaginary == 0, 0.0).otherwise(imaginary).alias("xim"),  # no negative zero at the two real bins
            (F.col("r1") * F.col("r1") + F.col("i1") * F.col("i1")).alias("p1"),
            (F.col("r2") * F.col("r2") + F.col("i2") * F.col("i2")).alias("p2"),
        )
    )


def pair_products_of_frames(frames: DataFrame, pairs: DataFrame, *, pair_keys: Sequence[str] = ("shot",)) -> DataFrame:
    """:func:`pair_products` from :func:`stft_frames`: whole frames meet, bins become rows last."""
    pk = list(pair_keys)
    extra = [c for c in pairs.columns if c not in (*pk, "ch1", "ch2")]
    one = frames.select(*pk, F.col("channel").alias("ch1"), "frame", "k_lo", F.col("re").alias("r1"), F.col("im").alias("i1"))
    two = frames.select(*pk, F.col("channel").alias("ch2"), "frame", F.col("re").alias("r2"), F.col("im").alias("i2"))
    met = blocks.join_small(one, pairs, [*pk, "ch1"]).join(two, [*pk, "ch2", "frame"])
    bins = met.select(*pk, "ch1", "ch2", *extra, "frame", "k_lo", F.posexplode(F.arrays_zip("r1", "i1", "r2", "i2")).alias("_p", "z"))
    r1, i1, r2, i2 = (F.col(f"z.{c}") for c in ("r1", "i1", "r2", "i2"))
    imaginary = r2 * i1 - i2 * r1
    return bins.select(
        *pk, "ch1", "ch2", *extra, "frame", (F.col("k_lo") + F.col("_p")).cast("int").alias("k"),
        (r2 * r1 + i2 * i1).alias("xre"), F.when(imaginary == 0, 0.0).otherwise(imaginary).alias("xim"),
        (r1 * r1 + i1 * i1).alias("p1"), (r2 * r2 + i2 * i2).alias("p2"))


def cross_spectrum(products: DataFrame, n_fft, fs, keys: Sequence[str] = ("shot", "ch1", "ch2"), taper_power=None) -> DataFrame:
    """Welch cross spectrum per pair and bin: density, coherence, phase, errors and mode number."""
    keys = list(keys)
    n = _col(n_fft)
    power_sum = _col(taper_power if taper_power is not None else S.hann_power(int(n_fft)))
    has_delta = "delta_phi" in products.columns
    group = [*keys, *(["delta_phi"] if has_delta else [])]
    avg = products.groupBy(*group, "k").agg(
        F.avg("xre").alias("xre"), F.avg("xim").alias("xim"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_segments"),
    )
    single = (F.col("k") == 0) | ((n % 2 == 0) & (F.col("k") == F.floor(n / 2)))
    scale = F.when(single, 1.0).otherwise(2.0) / (_col(fs) * power_sum)
    mag = F.hypot("xre", "xim")
    out = avg.select(
        *group, "k", (F.col("k") * _col(fs) / n).alias("f_hz"), (mag * scale).alias("power"),
        F.coalesce(mag * mag / F.nullif(F.col("p1") * F.col("p2"), F.lit(0.0)), F.lit(0.0)).alias("coherence"),
        F.degrees(F.atan2("xim", "xre")).alias("phase"), "n_segments",
    )
    out = out.withColumn("phase_error", S.phase_error("coherence", "n_segments")).withColumn(
        "amplitude_error", S.amplitude_error("coherence", "power", "n_segments")
    )
    return with_mode_number(out) if has_delta else out


def with_mode_number(df: DataFrame, phase: str = "phase") -> DataFrame:
    """n = rint(phase / delta_phi), half to even; a zero separation is an error."""
    checked = F.when(F.col("delta_phi") == 0, F.raise_error(F.lit("a mode number needs probes with non-zero separation"))) \
        .otherwise(F.col("delta_phi"))
    return df.withColumn("n", F.rint(F.col(phase) / checked).cast("int"))


def rms_by_mode(df: DataFrame, keys: Sequence[str], df_hz) -> DataFrame:
    """sqrt(sum(power) * df) per mode number; every resolvable n appears, modes outside are dropped."""
    keys = list(keys)
    sums = df.groupBy(*keys, "delta_phi", "n").agg(F.sum("power").alias("p"))
    limit = S.mode_limit("delta_phi")
    per_key = sums.groupBy(*keys, "delta_phi").agg(F.map_from_entries(F.collect_list(F.struct("n", "p"))).alias("m"))
    return per_key.select(*keys, "m", F.explode(F.sequence(-limit, limit)).alias("n")).select(
        *keys, "n", F.sqrt(F.coalesce(F.try_element_at("m", F.col("n")), F.lit(0.0)) * _col(df_hz)).alias("rms")
    )


# ---- spectrogram ---------------------------------------------------------------------
def _mirror_bins(df: DataFrame, keys: Sequence[str], k: str, n_bins, reach: int) -> DataFrame:
    """Rows plus their half-sample mirror images beyond both ends of the bin axis."""
    n = _col(n_bins)
    copies = F.array(
        F.col(k),
        F.when(F.col(k) < reach, -1 - F.col(k)),
        F.when(F.col(k) >= n - reach, 2 * n - 1 - F.col(k)),
    )
    return df.withColumn("_k", F.explode(F.array_compact(copies)))


def smooth_over_bins(df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: int, n_bins, k: str = "k") -> DataFrame:
    """Box average of ``cols`` over ``width`` neighbouring bins, mirrored at the edges.

    The window is partitioned by (key, frame): at most ``n_fft`` rows each.
    """
    before = width // 2
    w = Window.partitionBy(*keys).orderBy("_k").rowsBetween(-before, width - 1 - before)
    d = _mirror_bins(df, keys, k, n_bins, before)
    for c in cols:
        d = d.withColumn(f"{c}_s", F.avg(c).over(w))
    return d.where(F.col("_k") == F.col(k)).drop("_k")


def spectrogram(products: DataFrame, n_bins, coherence_smooth: int = 5, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Per-frame cross power, bin-smoothed coherence in [0, 1] and two-probe mode number."""
    keys = list(keys)
    out_cols = [*keys, "ch1", "ch2", "delta_phi", "frame", "k"]
    if coherence_smooth > 1:
        d = smooth_over_bins(products, [*keys, "ch1", "ch2", "frame"], ["xre", "xim", "p1", "p2"], coherence_smooth, n_bins)
        den = F.col("p1_s") * F.col("p2_s")
        coh = F.when(den > 0, (F.col("xre_s") ** 2 + F.col("xim_s") ** 2) / den).otherwise(0.0)
        coh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), coh))
    else:
        d, coh = products, F.lit(1.0)
    d = d.select(
        *out_cols, F.hypot("xre", "xim").alias("power"), coh.alias("coherence"),
        F.degrees(F.atan2("xim", "xre")).alias("phase"),
    )
    return with_mode_number(d)


def denoise(spec: DataFrame, *, coherence_min: float = 0.5, power_floor_k: float | None = 3.0,
            floor_percentile: float = 50.0, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Gate incoherent cells and cells below ``power_floor_k`` times their bin's floor to power 0."""
    keep = F.coalesce(F.nanvl(F.col("coherence"), F.lit(0.0)), F.lit(0.0)) >= coherence_min
    d = spec
    if power_floor_k is not None:
        floor = blocks.exact_percentile(spec, [*keys, "k"], "power", floor_percentile / 100.0, "_floor")
        d = spec.join(floor, [*keys, "k"])
        keep = keep & (F.col("power") >= power_floor_k * F.col("_floor"))
    return d.withColumn("power", F.when(keep, F.col("power")).otherwise(0.0)).drop("_floor")


def log_power(power: str = "power", gated: bool = True) -> Column:
    value = F.log10(F.greatest(F.col(power), F.lit(TINY)))
    return F.when(F.col(power) == 0, None).otherwise(value) if gated else value


def gaussian_taps(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * float(sigma) + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def smooth_axis(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], sigma: float) -> DataFrame:
    """Gaussian smoothing of several columns along one integer axis with mirrored edges.

    Blocks along the axis carry their halo, so neither a long time axis nor a single bin has to
    fit into one task.
    """
    if sigma <= 0:
        return df
    radius = int(4.0 * float(sigma) + 0.5)
    rest = [c for c in df.columns if c not in (*keys, idx, *cols)]
    out = blocks.filtered(df, keys, idx, {c: c for c in cols}, gaussian_taps, "reflect", param=float(sigma), before=radius, after=radius, carry=rest)
    return out.select(*df.columns)


def smooth_spectrogram(spec: DataFrame, *, sigma_time_bins: float, sigma_freq_bins: float,
                       keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Blur log power and linear coherence over time and frequency; n stays as it is."""
    st, sf = max(0.0, float(sigma_time_bins)), max(0.0, float(sigma_freq_bins))
    if st == 0 and sf == 0:
        return spec
    d = spec.withColumn("power", F.log10(F.greatest(F.col("power"), F.lit(TINY))))
    d = smooth_axis(d, [*keys, "k"], "frame", ["power", "coherence"], st)
    d = smooth_axis(d, [*keys, "frame"], "k", ["power", "coherence"], sf)
    return d.withColumn("power", F.pow(F.lit(10.0), F.col("power")))


def band(df: DataFrame, f_lo: float | None, f_hi: float | None, f: str = "f_hz") -> DataFrame:
    """Crop to a frequency band."""
    cond = F.lit(True)
    if f_lo is not None:
        cond = cond & (F.col(f) >= f_lo)
    if f_hi is not None:
        cond = cond & (F.col(f) <= f_hi)
    return df.where(cond)


def band_bins(n_fft, dt, f_lo: float, f_hi: float) -> tuple[Column, Column]:
    """Bin range of a band; an empty band falls back to the bin nearest ``f_lo``."""
    n, step = _col(n_fft), 1.0 / (_col(n_fft) * _col(dt))
    top = F.floor(n / 2)
    lo, hi = F.ceil(F.lit(float(f_lo)) / step), F.least(F.floor(F.lit(float(f_hi)) / step), top)
    near = F.least(top, F.ceil(F.lit(float(f_lo)) / step - 0.5))
    empty = lo > hi
    return F.when(empty, near).otherwise(lo), F.when(empty, near).otherwise(hi)


def spectrogram_levels(samples: DataFrame, build, max_columns: Sequence[int]) -> DataFrame:
    """Coarse-to-fine results: ``build(samples, cap)`` per column cap, tagged with its level."""
    out = None
    for level, cap in enumerate(max_columns):
        d = build(samples, cap).withColumn("level", F.lit(level)).withColumn(
            "progress", F.lit((level + 1) / len(max_columns))
        ).withColumn("final", F.lit(level == len(max_columns) - 1))
        out = d if out is None else out.unionByName(d)
    return out


def gate_retention(gated: DataFrame, original: DataFrame, on: Sequence[str], keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Share of cells and of power that a gate keeps."""
    both = original.select(*on, F.col("power").alias("_p0")).join(gated.select(*on, "power"), list(on))
    return both.groupBy(*keys).agg(
        (F.count_if(F.col("power") > 0) / F.count(F.lit(1))).alias("cells_kept"),
        (F.sum("power") / F.sum("_p0")).alias("power_kept"),
    )
