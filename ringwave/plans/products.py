"""The result products: every one is a function of an archive of recordings and a few parameters.

Each returns one DataFrame that holds the result for all recordings at once; filter on ``shot``
before or after. Nothing is collected; recordings that lack the needed probes simply have no rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.operators import align, blocks, condition, modes, shape, spatial, spectra, summaries
from ringwave.session import cut_lineage

MIN_SAMPLES = 256  # fixed: shorter records have no spectrogram
FULL_BAND = (1000.0, 25000.0)  # fixed: Hz kept for cursor analyses


@dataclass
class Archive:
    """Recordings and their geometry.

    ``samples``: shot, channel, i, t_ms, value. ``sensors``: shot, channel, phi, theta, r, z, length,
    tilt, delta_phi, kind, family and end points. ``arrays``: candidate tables ``pair``, ``toroidal``,
    ``poloidal``, ``grid`` (shot, pref, channel, phi, theta).
    """

    samples: DataFrame
    sensors: DataFrame
    arrays: dict[str, DataFrame]
    shots: DataFrame | None = None
    features: DataFrame | None = None
    sets: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    # ---- shared pieces -----------------------------------------------------------------
    def table(self, key, build) -> DataFrame:
        """An intermediate written once per archive and read by every product that needs it."""
        if key not in self.extra:
            self.extra[key] = cut_lineage(build())
        return self.extra[key]

    def have(self) -> DataFrame:
        return self.table("have", lambda: self.samples.select("shot", "channel").distinct())

    def seconds(self) -> DataFrame:
        return self.samples.withColumn("t_s", F.col("t_ms") * 1e-3)

    def present(self, name: str) -> DataFrame:
        return self.arrays[name].join(self.have(), ["shot", "channel"], "left_semi")

    def toroidal(self) -> DataFrame:
        return self.table("toroidal", lambda: summaries.usable_array(self.present("toroidal")).select("shot", "channel", "phi"))

    def poloidal(self) -> DataFrame:
        p = self.present("poloidal").where(F.col("theta").isNotNull()).withColumnsRenamed({"phi": "real_phi", "theta": "phi"})
        return self.table("poloidal", lambda: summaries.usable_array(p).select("shot", "channel", "phi", "real_phi"))

    def pair(self) -> DataFrame:
        return self.table("pair", lambda: summaries.widest_pair(self.present("pair")))

    def kappa(self, t0_ms: float | None = None) -> DataFrame:
        """Elongation per recording: median over the record, or interpolated at the cursor."""
        k = self.samples.where((F.col("channel") == "kappa") & ~F.isnan("value"))
        if t0_ms is None:
            val = blocks.exact_percentile(k, ["shot"], "value", 0.5, "kappa")
        else:
            grid = k.select("shot", "channel").distinct().withColumn("t_ms", F.lit(float(t0_ms)))
            val = align.interpolate(k, grid, ["shot", "channel"], 1e3, "t_ms").select("shot", F.col("value").alias("kappa"))
        return self.table(("kappa", t0_ms), lambda: val.withColumn("kappa", X.sane_kappa("kappa")))


def _clock(stacked: DataFrame) -> DataFrame:
    """n and median step per recording, from its first channel."""
    first = stacked.groupBy("shot").agg(F.min("channel").alias("channel"))
    one = blocks.join_small(stacked, first, ["shot", "channel"])
    n = one.groupBy("shot").agg(F.count(F.lit(1)).alias("n"))
    return n.join(spectra.median_step(one), "shot")


def _shown(d: DataFrame, cap: int | None, frames: DataFrame | None = None, idx: str = "frame") -> DataFrame:
    """At most ``cap`` evenly spaced columns, or all of them."""
    if cap is None:
        return d
    if frames is None:
        return summaries.display_columns(d, cap, idx=idx)
    return d.join(summaries.display_columns(frames, cap).select("shot", "frame"), ["shot", "frame"], "left_semi")


def _frames(stacked: DataFrame, lay: DataFrame) -> DataFrame:
    first = stacked.groupBy("shot").agg(F.min("channel").alias("channel"))
    one = blocks.join_small(blocks.join_small(stacked, first, ["shot", "channel"]), lay, "shot")
    return spectra.frame_times(one, "n_fft", "hop", "dt", ["shot", "n_columns"]).where(F.col("frame") < F.col("n_columns")).drop("n_columns")


# ---- two-probe spectrogram -----------------------------------------------------------------
def _pair_spectrogram(a: Archive, slice_duration=0.001, smoothing=5, max_columns=None) -> DataFrame:
    key = ("pair spectrogram", slice_duration, smoothing, max_columns)
    return a.table(key, lambda: _build_pair_spectrogram(a, slice_duration, smoothing, max_columns))


def _build_pair_spectrogram(a: Archive, slice_duration, smoothing, max_columns) -> DataFrame:
    pair = a.pair()
    members = pair.select("shot", F.explode(F.array("ch1", "ch2")).alias("channel"))
    stacked = a.table("pair samples", lambda: align.stack(a.seconds(), members))
    clock = a.table("pair clock", lambda: _clock(stacked).where(F.col("n") >= MIN_SAMPLES))
    lay = cut_lineage(spectra.layout(clock, slice_duration, max_columns))
    framed = blocks.join_small(stacked, lay.select("shot", "n_fft", "hop"), "shot")
    spec = cut_lineage(spectra.stft_frames(framed, "n_fft", "hop"))
    prod = blocks.join_small(spectra.pair_products_of_frames(spec, pair.select("shot", "ch1", "ch2", "delta_phi")), lay.select("shot", "n_fft"), "shot")
    res = spectra.spectrogram(prod, F.floor(F.col("n_fft") / 2) + 1, max(2, smoothing))
    return _with_axes(res, lay, _frames(stacked, lay))


def _with_axes(cells: DataFrame, lay: DataFrame, frames: DataFrame) -> DataFrame:
    f = lay.select("shot", (1.0 / (F.col("n_fft") * F.col("dt"))).alias("df_hz"))
    return blocks.join_small(cells, f, "shot").join(frames, ["shot", "frame"]).withColumn("f_hz", F.col("k") * F.col("df_hz"))


def _prepared_spectrogram(a: Archive, *, slice_duration=0.001, smoothing=5, max_columns=None, sigma_time=0.0, sigma_freq=0.0, denoise=False,
                          coherence_min=0.0, power_floor_k=None, floor_percentile=50.0) -> DataFrame:
    d = _pair_spectrogram(a, slice_duration, smoothing, max_columns)
    if sigma_time > 0 or sigma_freq > 0:
        key = ("smoothed", slice_duration, smoothing, max_columns, sigma_time, sigma_freq)
        raw = d
        d = a.table(key, lambda: spectra.smooth_spectrogram(raw, sigma_time_bins=sigma_time, sigma_freq_bins=sigma_freq))
    if denoise:
        floor = power_floor_k if power_floor_k and power_floor_k > 0 else None
        d = spectra.denoise(d, coherence_min=coherence_min, power_floor_k=floor, floor_percentile=floor_percentile)
    return d


def _crop(d: DataFrame, fmin=None, fmax=None) -> DataFrame:
    """Band in kHz."""
    return spectra.band(d, None if fmin is None else fmin * 1e3, None if fmax is None else fmax * 1e3)


def _cell(d: DataFrame, z: Column, *more: str) -> DataFrame:
    return d.select("shot", "frame", (F.col("t_s") * 1e3).alias("t_ms"), "k", (F.col("f_hz") / 1e3).alias("f_khz"), z.alias("z"), *more)


def spectrogram(a: Archive, *, fmin=None, fmax=None, denoise=False, **kw) -> DataFrame:
    d = _crop(_prepared_spectrogram(a, denoise=denoise, **kw), fmin, fmax)
    return _cell(d, spectra.log_power(gated=denoise), "ch1", "ch2", "delta_phi")


def coherence(a: Archive, *, fmin=None, fmax=None, **kw) -> DataFrame:
    return _cell(_crop(_prepared_spectrogram(a, **kw), fmin, fmax), F.col("coherence"), "ch1", "ch2")


def n_spectrum(a: Archive, **kw) -> DataFrame:
    d = _prepared_spectrogram(a, **kw)
    rms = spectra.rms_by_mode(d, ["shot", "frame", "t_s", "df_hz"], F.col("df_hz"))
    return rms.select("shot", "frame", (F.col("t_s") * 1e3).alias("t_ms"), "n", "rms")


def short_recordings(a: Archive) -> DataFrame:
    """Recordings that the two-probe products leave out, with the reason."""
    members = a.pair().select("shot", F.explode(F.array("ch1", "ch2")).alias("channel"))
    n = _clock(align.stack(a.seconds(), members)).where(F.col("n") < MIN_SAMPLES)
    return n.select("shot", "n", F.format_string(f"%d samples are fewer than {MIN_SAMPLES}", "n").alias("reason"))


def spectrogram_levels(a: Archive, max_columns=(250, 1000, 4000), **kw) -> DataFrame:
    """Coarse-to-fine frames of the spectrogram on one frequency axis."""
    return spectra.spectrogram_levels(a.samples, lambda _s, cap: spectrogram(a, max_columns=cap, **kw), max_columns)


# ---- array mode numbers --------------------------------------------------------------------
def _array_spectrum(a: Archive, name: str, *, f_lo=FULL_BAND[0], f_hi=FULL_BAND[1], slice_duration=0.001, max_columns=None):
    """(spectra, layout, frames) of a whole array; only the band leaves the transform."""
    members = a.toroidal() if name == "toroidal" else a.poloidal()
    stacked = a.table((name, "samples"), lambda: align.stack(a.seconds(), members.select("shot", "channel")))
    clock = a.table((name, "clock"), lambda: _clock(stacked))
    key = (name, f_lo, f_hi, slice_duration, max_columns)
    lay = a.table((*key, "layout"), lambda: spectra.layout(clock, slice_duration, max_columns))
    lo, hi = spectra.band_bins("n_fft", "dt", f_lo, f_hi)
    spec = a.table((*key, "spectra"), lambda: stft_band_limited(stacked, lay, lo, hi))
    return spec, lay, a.table((*key, "frames"), lambda: _frames(stacked, lay))


def stft_band_limited(stacked: DataFrame, lay: DataFrame, lo: Column, hi: Column) -> DataFrame:
    d = blocks.join_small(stacked, lay.select("shot", "n_fft", "hop", lo.alias("k_lo"), hi.alias("k_hi")), "shot")
    return spectra.stft(d, "n_fft", "hop", "k_lo", "k_hi")


def mode_number(a: Archive, *, slice_duration=0.002, sigma_time=0.0, sigma_freq=0.0, n_gate=0.3, n_amp_pct=80.0, fmin=None, fmax=None,
                n_max=5, max_columns=None, columns=None) -> DataFrame:
    """|n| map from the whole array; recordings without one fall back to the two-probe estimate.

    The gate is set by all cells; ``columns`` thins what is returned, as the last step.
    """
    arr = a.toroidal()
    spec, lay, frames = _array_spectrum(a, "toroidal", f_lo=0.0, f_hi=50e3, slice_duration=slice_duration, max_columns=max_columns)
    m = a.table(("mode map", slice_duration, max_columns, n_max), lambda: modes.mode_map(spec, arr, n_max))
    m = spectra.smooth_axis(m, ["shot", "k"], "frame", ["quality", "amplitude"], sigma_time)
    m = spectra.smooth_axis(m, ["shot", "frame"], "k", ["quality", "amplitude"], sigma_freq)
    m = cut_lineage(_crop(_with_axes(m, lay, frames), fmin, fmax))
    m = _shown(modes.gate_mode_map(m, n_gate=n_gate, n_amp_pct=n_amp_pct), columns, frames)
    whole = _cell(m, F.col("z"), "quality", "amplitude").withColumn("method", F.lit("array"))
    rest = a.extra.setdefault("without array", Archive(blocks.join_small(a.samples, arr.select("shot").distinct(), "shot", "left_anti"), a.sensors, a.arrays))
    two = _crop(_prepared_spectrogram(rest, slice_duration=slice_duration, max_columns=max_columns, sigma_time=sigma_time, sigma_freq=sigma_freq), fmin, fmax)
    two = _cell(two.withColumns({"quality": F.lit(None).cast("double"), "amplitude": F.lit(None).cast("double")}),
                F.abs("n").cast("double"), "quality", "amplitude").withColumn("method", F.lit("pair"))
    return whole.unionByName(two)


def auto_frequency(a: Archive, t0_ms: float | None = None) -> DataFrame:
    d = _pair_spectrogram(a)
    at = None if t0_ms is None else d.select("shot").distinct().withColumn("t0", F.lit(t0_ms * 1e-3))
    return modes.auto_frequency(d, at=at)


def _nearest_bin(lay: DataFrame, f_hz: Column) -> Column:
    lo, hi = spectra.band_bins("n_fft", "dt", *FULL_BAND)
    return F.greatest(lo, F.least(hi, F.ceil(f_hz * F.col("n_fft") * F.col("dt") - 0.5))).cast("int")


def _frequency(a: Archive, f_khz: float | None, t0_ms: float | None) -> DataFrame:
    if f_khz is not None:
        return a.have().select("shot").distinct().withColumn("f_khz", F.lit(float(f_khz)))
    return auto_frequency(a, t0_ms)


def _mode_at_cursor(a: Archive, name: str, f_khz, time) -> DataFrame:
    """Per-probe phase of an array at the cursor, against its first probe by angle."""
    return a.table(("cursor", name, f_khz, time), lambda: _build_mode_at_cursor(a, name, f_khz, time))


def _build_mode_at_cursor(a: Archive, name: str, f_khz, time) -> DataFrame:
    arr = a.toroidal() if name == "toroidal" else a.poloidal()
    spec, lay, frames = _array_spectrum(a, name)
    mid = frames.groupBy("shot").agg(F.max("frame").alias("_top"))
    t0 = blocks.join_small(frames, mid, "shot").where(F.col("frame") == F.floor((F.col("_top") + 1) / 2)).select("shot", F.col("t_s").alias("t0"))
    if time is not None:
        t0 = mid.select("shot", F.lit(float(time) * 1e-3).alias("t0"))
    cursors = t0.withColumn("slice", F.lit(0))
    picked = modes.cursor_frames(cursors, frames)
    k = lay.join(_frequency(a, f_khz, time), "shot").select("shot", "f_khz", _nearest_bin(lay, F.col("f_khz") * 1e3).alias("k"))
    ref = arr.groupBy("shot").agg(F.min_by("channel", F.struct("phi", "channel")).alias("ref"))
    mode = modes.mode_at(spec, arr.select("shot", "channel", "phi"), picked.join(k, "shot"), ref)
    return mode.join(k.select("shot", "f_khz"), "shot").join(t0, "shot")


def toroidal_mode(a: Archive, *, f_khz=None, time=None) -> DataFrame:
    return _mode_at_cursor(a, "toroidal", f_khz, time)


def poloidal_mode(a: Archive, *, f_khz=None, time=None) -> DataFrame:
    """Poloidal phases with the toroidal ramp removed and angles corrected for elongation."""
    arr = a.poloidal()
    mode = _mode_at_cursor(a, "poloidal", f_khz, time)
    n = modes.circular_fit(toroidal_mode(a, f_khz=f_khz, time=time), ["shot"]).select("shot", F.col("n").alias("toroidal_n"))
    d = mode.join(arr.select("shot", "channel", "real_phi"), ["shot", "channel"]).join(n, "shot").join(a.kappa(time), "shot", "left")
    return d.withColumns({"phase": X.remove_toroidal_ramp("phase", "toroidal_n", F.coalesce("real_phi", F.lit(0.0))), "phi": X.theta_star("phi", "kappa")})


def _phase_fit(mode: DataFrame) -> DataFrame:
    fit = modes.circular_fit(mode, ["shot"])
    return mode.join(fit, "shot").select(
        "shot", "channel", "phi", "phase", F.when(~F.isnan("phase_error"), F.round("phase_error", 3)).alias("phase_error"),
        "f_khz", "n", "intercept_deg", "resultant", "n_confidence", "phase_sigma")


def phase_fit(a: Archive, **kw) -> DataFrame:
    return _phase_fit(toroidal_mode(a, **kw))


def poloidal_phase_fit(a: Archive, **kw) -> DataFrame:
    return _phase_fit(poloidal_mode(a, **kw))


def phase_fit_line(a: Archive, *, poloidal=False, **kw) -> DataFrame:
    mode = poloidal_mode(a, **kw) if poloidal else toroidal_mode(a, **kw)
    return modes.wrapped_ramp(modes.circular_fit(mode, ["shot"]), ["shot"])


def _smooth_shape(mode: DataFrame) -> DataFrame:
    d = shape.shape_noise(modes.shape_vector(mode), ["shot"])
    g = shape.gp_mode_shape(d, ["shot"])
    bands = {f"{p}_{side}": F.col(f"{p}_mean") + sign * 2.0 * F.col(f"{p}_sigma") for p in ("re", "im") for side, sign in (("lower", -1.0), ("upper", 1.0))}
    return g.withColumns(bands)


def mode_shape(a: Archive, **kw) -> DataFrame:
    return _smooth_shape(toroidal_mode(a, **kw))


def poloidal_shape(a: Archive, **kw) -> DataFrame:
    return _smooth_shape(poloidal_mode(a, **kw))


def mode_pattern(a: Archive, **kw) -> DataFrame:
    return shape.pattern(mode_shape(a, **kw), poloidal_shape(a, **kw), ["shot"])


def pattern_overlay(a: Archive, *, time=None) -> DataFrame:
    """Where the pattern is sampled: poloidal probes at (phi, theta*), toroidal ones at theta 0."""
    pol = a.poloidal().join(a.kappa(time), "shot", "left").select("shot", "channel", F.col("real_phi").alias("x"), X.theta_star("phi", "kappa").alias("y"))
    return pol.where(F.col("x").isNotNull()).unionByName(a.toroidal().select("shot", "channel", F.col("phi").alias("x"), F.lit(0.0).alias("y")))


# ---- tracks ----------------------------------------------------------------------------------
def _track_inputs(a: Archive, n_slices: int | None):
    arr = a.toroidal()
    spec, lay, frames = _array_spectrum(a, "toroidal")
    window = a.table("active window", lambda: modes.active_window(spec, frames))
    bounds = modes.frames_in_window(frames, window)
    if n_slices is None:
        inside = bounds.select("shot", F.explode(F.sequence("lo", "hi")).alias("frame"))
    else:
        inside = modes.even_slices(bounds, n_slices)
    idx = inside.join(frames, ["shot", "frame"])
    idx = a.table(("slices", n_slices), lambda d=idx: d)
    cursors = idx.select("shot", F.col("frame").cast("int").alias("slice"), F.col("t_s").alias("t0"))
    ref = arr.groupBy("shot").agg(F.min_by("channel", F.struct("phi", "channel")).alias("ref"))
    return arr, spec, lay, frames, cursors, ref


def mode_track(a: Archive, *, f_khz=None, n_slices=None) -> DataFrame:
    """Similarity of the array shape to its strongest slice, and n, over the active time."""
    arr, spec, lay, frames, cursors, ref = _track_inputs(a, n_slices)
    k = lay.join(_frequency(a, f_khz, None), "shot").select("shot", _nearest_bin(lay, F.col("f_khz") * 1e3).alias("k"))
    mode = cut_lineage(modes.mode_at(spec, arr, modes.cursor_frames(cursors, frames).join(k, "shot"), ref))
    tr = cut_lineage(modes.track(mode))
    return tr.join(cursors, ["shot", "slice"]).join(modes.dominant_mode(tr), "shot").select(
        "shot", "slice", (F.col("t0") * 1e3).alias("t_ms"), "mac", "n", "ref_slice", "dominant_n")


def mode_over_time(a: Archive, *, n_slices=None) -> DataFrame:
    """n of the strongest in-band mode at each slice, at that slice's own frequency."""
    arr, spec, lay, frames, cursors, ref = _track_inputs(a, n_slices)
    ridge = modes.dominant_bin(spec, cursors.select("shot", F.col("slice").cast("long").alias("frame")))
    picked = modes.cursor_frames(cursors, frames).join(ridge.select("shot", F.col("frame").cast("int").alias("slice"), "k"), ["shot", "slice"])
    mode = cut_lineage(modes.mode_at(spec, arr, picked, ref))
    fit = modes.circular_fit(mode, ["shot", "slice"]).select("shot", "slice", "n")
    amp = mode.groupBy("shot", "slice", "k").agg(F.sum("amplitude").alias("amplitude"))
    d = amp.join(fit, ["shot", "slice"]).join(cursors, ["shot", "slice"]).join(lay.select("shot", "n_fft", "dt"), "shot")
    d = d.select("shot", "slice", (F.col("t0") * 1e3).alias("t_ms"), "n", (F.col("k") / (F.col("n_fft") * F.col("dt")) / 1e3).alias("f_khz"), "amplitude")
    d = cut_lineage(d)
    return d.join(modes.dominant_mode(d), "shot")


# ---- raw array views ----------------------------------------------------------------------------
def contour(a: Archive, *, columns=None, points=73) -> DataFrame:
    """Raw field over angle and time of the toroidal array, in gauss."""
    arr = a.table("grid", lambda: summaries.usable_array(a.present("grid"), distinct=False).select("shot", "channel", "phi"))
    stacked = a.table("grid samples", lambda: align.stack(a.samples, arr.select("shot", "channel")))
    thin = _shown(stacked, columns, idx="i")
    z = align.on_angle_grid(thin, align.angle_weights(arr, points), along=("i", "t_ms"))
    return z.withColumn("z", F.col("z") * X.TESLA_TO_GAUSS)


def _stripes(a: Archive, arr: DataFrame, f_khz, time, cycles=8, times=None, angles=120) -> DataFrame:
    stacked = cut_lineage(align.stack(a.samples, arr.select("shot", "channel")))
    f = _frequency(a, f_khz, time)
    mid = stacked.groupBy("shot").agg((F.max("i") + 1).alias("_n"))
    centre = blocks.join_small(stacked, mid, "shot").where(F.col("i") == F.floor(F.col("_n") / 2)).groupBy("shot").agg(F.first("t_ms").alias("_t0"))
    d = blocks.join_small(blocks.join_small(stacked, centre, "shot"), f, "shot")
    t0 = F.col("_t0") if time is None else F.lit(float(time))
    half = F.greatest(F.lit(0.3), 0.5 * cycles / F.greatest(F.col("f_khz"), F.lit(0.5)))
    cut = align.cursor_window(d, t0 - half, t0 + half, 4, 160, ["shot", "channel"], "t_ms").drop("_t0", "f_khz")
    cut = cut_lineage(align.reindex(cut))
    thin = _shown(cut, times, idx="i")
    return align.on_angle_grid(thin, align.angle_weights(arr, angles), along=("i", "t_ms"))


def toroidal_stripes(a: Archive, *, f_khz=None, time=None) -> DataFrame:
    return _stripes(a, a.toroidal(), f_khz, time)


def poloidal_stripes(a: Archive, *, f_khz=None, time=None) -> DataFrame:
    return _stripes(a, a.poloidal(), f_khz, time)


def raw_trace(a: Archive, *, time=None, half_ms=2.0, points=None) -> DataFrame:
    """The first toroidal probe around the cursor."""
    first = a.toroidal().groupBy("shot").agg(F.min_by("channel", F.struct("phi", "channel")).alias("channel"))
    one = blocks.join_small(a.samples, first, ["shot", "channel"])
    mid = one.groupBy("shot").agg(F.count(F.lit(1)).alias("_n"))
    centre = blocks.join_small(one, mid, "shot").where(F.col("i") == F.floor(F.col("_n") / 2)).select("shot", F.col("t_ms").alias("_t0"))
    t0 = F.col("_t0") if time is None else F.lit(float(time))
    cut = align.cursor_window(blocks.join_small(one, centre, "shot"), t0 - half_ms, t0 + half_ms, 2, 2000, ["shot"], "t_ms").drop("_t0")
    return _shown(cut_lineage(align.reindex(cut)), points, idx="i")


# ---- quasi-stationary fit -------------------------------------------------------------------------
@dataclass
class FitRun:
    """All tables of one load-prepare-fit run."""

    raw: DataFrame
    prepared: DataFrame
    basis: DataFrame
    inverse: DataFrame
    meta: DataFrame
    coef: DataFrame
    n_modes: int

    def rows(self) -> DataFrame:
        return spatial.mode_rows(self.coef, self.meta, self.n_modes)

    def fitted(self) -> DataFrame:
        return spatial.fitted_signal(self.prepared, self.coef, self.inverse, self.n_modes)


def prepare(samples: DataFrame, *, t_lo: float, t_hi: float, cutoff=(5.0, 250.0), detrend="baseline", detrend_band=None, energy=0.98,
            do_integrate=False, coils: DataFrame | None = None, coupling: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Trim with padding, compensate, swap, integrate, filter, un-pad, detrend, remove noise."""
    d = align.padded_window(samples, t_lo, t_hi, cutoff[0])
    d = align.reindex(d, ["shot"])
    if coils is not None and coupling is not None:
        d = align.compensate(d, coils, coupling)
    d = cut_lineage(align.swap_pair(d))
    clock = cut_lineage(_even_clock(d))
    if do_integrate:
        d = blocks.join_small(d, clock.select("shot", "dt"), "shot")
        d = condition.integrate(d, remove=False).drop("dt")
    d = cut_lineage(condition.band_filter(d, clock, *cutoff))
    d = cut_lineage(align.reindex(align.trim(d, t_lo, t_hi), ["shot"]))
    band = detrend_band or (t_lo, t_lo + 0.01)
    d = condition.detrend(d, detrend, [band])
    return condition.svd_condition(cut_lineage(d.select("shot", "channel", "i", "t_s", "value")), energy)


def _even_clock(d: DataFrame) -> DataFrame:
    """Samples per channel and step between the first two samples."""
    per = d.groupBy("shot", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("t_s").alias("_a"), F.min(F.when(F.col("i") == 1, F.col("t_s"))).alias("_b"))
    return per.groupBy("shot").agg(F.max("n").alias("n"), F.min(F.col("_b") - F.col("_a")).alias("dt"))


def run_fit(a: Archive, *, t_lo: float, t_hi: float, channels: DataFrame | None = None, ns=(1, 2, 3), ms=(0,), helicity=-1, basis="sinusoidal-integral",
            geometry="cylindrical", fit_cond=10.0, ncenters=6, mcenters=1, width=1.0, **prep) -> FitRun:
    """Load on one clock, prepare and fit. ``channels`` restricts (shot, channel) or (channel).

    The aligned and prepared samples, the inversion and the coefficients are written once; products
    called with the same parameters on the same archive and without extra tables share the run.
    """
    key = ("fit", t_lo, t_hi, tuple(ns), tuple(ms), helicity, basis, geometry, fit_cond, ncenters, mcenters, width, repr(sorted(prep.items(), key=str)))
    shared = channels is None and not any(isinstance(v, DataFrame) for v in prep.values())
    if shared and key in a.extra:
        return a.extra[key]
    geo = a.sensors.where(F.col("phi_end1").isNotNull())
    if channels is not None:
        geo = geo.join(channels, [c for c in channels.columns if c in ("shot", "channel")], "left_semi")
    raw = blocks.join_small(a.seconds(), geo.select("shot", "channel"), ["shot", "channel"], "left_semi").where(~F.isnan("value"))
    clock = cut_lineage(align.common_clock(raw))
    aligned = align.interpolate(raw, blocks.join_small(clock, raw.select("shot", "channel").distinct(), "shot"), ["shot", "channel"], width)
    order = blocks.row_index(clock, ["shot"], ["t_s"], F.floor(F.col("t_s") / width))
    aligned = cut_lineage(aligned.join(order, ["shot", "t_s"]))
    prepared, svd = prepare(aligned, t_lo=t_lo, t_hi=t_hi, **prep)
    prepared = cut_lineage(prepared)
    used = geo.join(prepared.select("shot", "channel").distinct(), ["shot", "channel"], "left_semi")
    if "sigma" not in used.columns:
        used = used.withColumn("sigma", F.lit(spatial.DEFAULT_SIGMA))
    rows = spatial.basis_rows(spatial.fill_sigma(used, default=spatial.DEFAULT_SIGMA, positive=False), ns=ns, ms=ms, helicity=helicity, basis=basis,
                              geometry=geometry, ncenters=ncenters, mcenters=mcenters)
    inverse = cut_lineage(spatial.invert_design(rows, fit_cond=fit_cond))
    n_modes = ncenters * mcenters if basis.startswith("gaussian") else len(spatial.mode_list(ns, ms, helicity))
    coef = cut_lineage(spatial.fit_coefficients(prepared, inverse, n_modes))
    run = FitRun(aligned, prepared, svd, inverse, spatial.fit_meta(inverse), coef, n_modes)
    if shared:
        a.extra[key] = run
    return run


def qs_fit(a: Archive, *, time=None, **kw) -> DataFrame:
    """Field over phi and theta at the slice nearest the cursor (median time by default), in gauss."""
    run = run_fit(a, **kw)
    if time is None:
        t0 = blocks.exact_percentile(run.coef, ["shot"], "t_s", 0.5, "t0")
    else:
        t0 = run.coef.select("shot").distinct().withColumn("t0", F.lit(float(time) * 1e-3))
    at = blocks.join_small(run.coef, t0, "shot").groupBy("shot").agg(F.min_by("i", F.struct(F.abs(F.col("t_s") - F.col("t0")), "i")).alias("i"))
    rows = blocks.join_small(run.rows(), at, ["shot", "i"])
    top = rows.groupBy("shot").agg(F.max_by(F.struct("n", "m"), F.struct(F.hypot("re", "im"), -F.col("mode"))).alias("_d"))
    z = spatial.field_map(rows, ["shot", "t_s"])
    return z.join(top, "shot").select("shot", "t_s", F.col("x").alias("phi"), F.col("y").alias("theta"), F.round("z", 4).alias("z"),
                                      F.col("_d.n").alias("dominant_n"), F.col("_d.m").alias("dominant_m"))


def phi_t(a: Archive, *, theta=0.0, **kw) -> DataFrame:
    z = spatial.phi_time_map(run_fit(a, **kw).rows(), ["shot", "i", "t_s"], theta=theta)
    return z.select("shot", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.col("x").alias("phi"), F.round("z", 4).alias("z"))


def amplitude(a: Archive, **kw) -> DataFrame:
    d = spatial.amplitude_phase(run_fit(a, **kw).rows())
    g = X.TESLA_TO_GAUSS
    return d.select("shot", "label", "n", "m", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.round(F.col("amplitude") * g, 4).alias("amplitude"),
                    F.round(F.col("amplitude_error") * g, 4).alias("sigma"))


def phase_t(a: Archive, **kw) -> DataFrame:
    rows = run_fit(a, **kw).rows()
    d = blocks.join_small(spatial.amplitude_phase(rows), summaries.phase_visible(rows).select("shot", "mode", "visible"), ["shot", "mode"])
    return d.select("shot", "label", "n", "m", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.round("phase", 3).alias("phase"),
                    F.round("phase_error", 3).alias("sigma"), "visible")


def fit_quality(a: Archive, **kw) -> DataFrame:
    run = run_fit(a, **kw)
    chi = spatial.chi_square(run.coef, run.inverse, run.n_modes).groupBy("shot").agg(F.avg("red_chi_sq").alias("mean_red_chi_sq"))
    return run.meta.join(chi, "shot").select(
        "shot", "raw_cn", X.k_quality("raw_cn").alias("raw_quality"), "eff_cn", X.k_quality("eff_cn").alias("eff_quality"), "mean_red_chi_sq",
        F.col("n_sensors").alias("channels"), F.size("mode_n").alias("modes"))


def fit_quality_geometry(a: Archive) -> DataFrame:
    """Condition number from geometry alone, for recordings without a fit."""
    return spatial.condition_number(summaries.usable_array(a.present("grid"), distinct=False))


def chi_sq_t(a: Archive, **kw) -> DataFrame:
    run = run_fit(a, **kw)
    return spatial.chi_square(run.coef, run.inverse, run.n_modes).select("shot", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.round("red_chi_sq", 6).alias("red_chi_sq"))


def fit_signals(a: Archive, **kw) -> DataFrame:
    """Prepared and fitted signal per channel."""
    d = run_fit(a, **kw).fitted()
    return d.select("shot", "channel", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.round("value", 8).alias("signal"), F.round("fit", 8).alias("fit"))


def fit_residuals(a: Archive, *, worst=6, **kw) -> DataFrame:
    d = run_fit(a, **kw).fitted()
    top = summaries.top_by_swing(d, ["shot"], "channel", "residual", worst).select("shot", "channel", F.lit(True).alias("worst"))
    return blocks.join_small(d, top, ["shot", "channel"], "left").select(
        "shot", "channel", F.round(F.col("t_s") * 1e3, 2).alias("t_ms"), F.round("residual", 8).alias("residual"), F.coalesce("worst", F.lit(False)).alias("worst"))


def signal_conditioning(a: Archive, *, width=1.0, **kw) -> DataFrame:
    """Prepared signal next to the raw one shifted to the same start value."""
    run = run_fit(a, width=width, **kw)
    raw = run.raw.select("shot", "channel", "t_s", "value")
    at = align.interpolate(blocks.join_small(raw, run.prepared.select("shot", "channel").distinct(), ["shot", "channel"], "left_semi"),
                           run.prepared.select("shot", "channel", "t_s"), ["shot", "channel"], width).withColumnRenamed("value", "raw")
    d = run.prepared.join(at, ["shot", "channel", "t_s"])
    start = d.groupBy("shot", "channel").agg(F.min_by("raw", "t_s").alias("_r0"), F.min_by("value", "t_s").alias("_p0"))
    return blocks.join_small(d, start, ["shot", "channel"]).select(
        "shot", "channel", F.round(F.col("t_s") * 1e3, 3).alias("t_ms"), F.round("value", 8).alias("prepared"),
        F.round(F.col("raw") - F.col("_r0") + F.col("_p0"), 8).alias("raw"))


def svd_diagnostics(a: Archive, **kw) -> DataFrame:
    """Cumulative energy of the data matrix with the kept rank."""
    b = run_fit(a, **kw).basis
    return b.select("shot", "rank", F.posexplode(F.arrays_zip("svals", "energy_fraction")).alias("idx", "_v")).select("shot", "rank", "idx", "_v.*")


# ---- geometry views ---------------------------------------------------------------------------------
def geometry(a: Archive) -> DataFrame:
    """Sensor layout: one record per sensor and recording."""
    cols = ("name", "family", "kind", "shape", "phi", "theta", "r", "z", "length", "delta_phi", "tilt")
    d = a.sensors.where(F.col("r").isNotNull() & F.col("z").isNotNull() & F.col("phi").isNotNull()).withColumn("name", F.col("channel"))
    return d.select("shot", *cols)


def sensor_map_rz(a: Archive) -> DataFrame:
    return a.sensors.select("shot", "channel", F.array("r_end1", "r_end2").alias("r"), F.array("z_end1", "z_end2").alias("z"))


def sensor_map_cylindrical(a: Archive) -> DataFrame:
    """Sensor outlines in (phi, theta) without jumps across the seam."""
    p1, p2, t1, t2 = (F.col(c) for c in ("phi_end1", "phi_end2", "theta_end1", "theta_end2"))
    return a.sensors.select("shot", "channel", X.no_wrap(F.array(p1, p2, p2, p1, p1)).alias("phi"), X.no_wrap(F.array(t1, t1, t2, t2, t1)).alias("theta"))


def channel_usage(a: Archive) -> DataFrame:
    """Which channels each analysis uses, and which are idle."""
    pair = a.pair().select("shot", F.explode(F.array("ch1", "ch2")).alias("channel"), F.lit("2-point spectrogram").alias("role"))
    tor = a.toroidal().select("shot", "channel", F.lit("toroidal n-fit array").alias("role"))
    pol = a.poloidal().select("shot", "channel", F.lit("poloidal array").alias("role"))
    return summaries.channel_usage(a.have(), pair.unionByName(tor).unionByName(pol))


def single_time_spectrum(a: Archive, *, time: float, power_pct: float = 0.0, **kw) -> DataFrame:
    """Power, coherence and |n| of the columns nearest a time; n is zeroed below a power percentile."""
    spec = _prepared_spectrogram(a, **kw)
    near = spec.select("shot", "frame", "t_s").distinct().groupBy("shot").agg(
        F.min_by("frame", F.struct(F.abs(F.col("t_s") * 1e3 - time), "frame")).alias("frame"))
    col = spec.join(near, ["shot", "frame"])
    n = cut_lineage(mode_number(a))
    n_at = n.select("shot", "frame", "t_ms").distinct().groupBy("shot").agg(F.min_by("frame", F.struct(F.abs(F.col("t_ms") - time), "frame")).alias("frame"))
    n_col = n.join(n_at, ["shot", "frame"]).select("shot", F.col("f_khz").alias("_f"), F.col("z").alias("_z"))
    cells = n_col.groupBy("shot").agg(F.sort_array(F.collect_list(F.struct("_f", "_z"))).alias("_n"))  # one column of bins
    floor = summaries.percentile_or_empty(col, ["shot"], "power", power_pct, "_floor")
    d = col.join(cells, "shot", "left").join(floor, "shot")
    f = F.col("f_hz") / 1e3
    nearest_n = F.array_min(F.transform("_n", lambda x: F.struct(F.abs(x["_f"] - f).alias("d"), x["_f"].alias("f"), x["_z"].alias("z"))))["z"]
    return d.select("shot", f.alias("f_khz"), "power", "coherence",
                    F.when(F.col("power") >= F.col("_floor"), F.coalesce(nearest_n, F.lit(0.0))).otherwise(0.0).alias("n"))


PRODUCTS = {
    "geometry": (geometry, "scatter2d"), "spectrogram": (spectrogram, "heatmap"), "mode_number": (mode_number, "heatmap"),
    "coherence": (coherence, "heatmap"), "n_spectrum": (n_spectrum, "heatmap"), "contour": (contour, "contour"),
    "phi_t": (phi_t, "contour"), "qs_fit": (qs_fit, "contour"), "amplitude": (amplitude, "line"), "phase_t": (phase_t, "line"),
    "fit_quality": (fit_quality, "metrics"), "phase_fit": (phase_fit, "scatter2d"), "sensor_map_rz": (sensor_map_rz, "line"),
    "sensor_map_cylindrical": (sensor_map_cylindrical, "line"), "signal_conditioning": (signal_conditioning, "line"),
    "chi_sq_t": (chi_sq_t, "line"), "fit_signals": (fit_signals, "line"), "fit_residuals": (fit_residuals, "line"),
    "mode_shape": (mode_shape, "line"), "poloidal_shape": (poloidal_shape, "line"), "mode_pattern": (mode_pattern, "contour"),
    "mode_track": (mode_track, "line"), "mode_over_time": (mode_over_time, "line"), "toroidal_stripes": (toroidal_stripes, "heatmap"),
    "poloidal_stripes": (poloidal_stripes, "heatmap"), "poloidal_phase_fit": (poloidal_phase_fit, "scatter2d"), "raw_trace": (raw_trace, "line"),
}


def build(a: Archive, name: str, **params) -> DataFrame:
    """A product by name."""
    if name not in PRODUCTS:
        raise KeyError(f"unknown product {name!r}; have {', '.join(sorted(PRODUCTS))}")
    return PRODUCTS[name][0](a, **params)
