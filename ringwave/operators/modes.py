"""Array mode numbers: projections, circular fits, shape similarity and tracks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwave.functions import spectral as S
from ringwave.functions.scalar import wrap180, wrap360
from ringwave.operators import blocks
from ringwave.operators import spectra as spectral
from ringwave.operators.spectra import TINY, _col
from ringwave.session import cut_lineage


def best_of(values: Sequence[tuple[int, Column]]) -> Column:
    """(value, n) struct of the largest value; ties go to the first candidate listed."""
    items = F.array(*[F.struct(v.alias("v"), F.lit(-j).alias("o"), F.lit(n).alias("n")) for j, (n, v) in enumerate(values)])
    return F.array_max(items)


# ---- projection of the whole array -----------------------------------------------------
def mode_map(spectra: DataFrame, angles: DataFrame, n_max: int = 5, keys: Sequence[str] = ("shot", "frame", "k")) -> DataFrame:
    """Best n, amplitude and energy fraction per cell from all probes.

    One aggregation with a pair of sums per candidate n. The probes of a cell come from different tasks, so
    partial sums would not combine before the shuffle and be many times a cell's own size: the cells are dealt out first.
    """
    on = [c for c in angles.columns if c != "phi"]
    ns = list(range(-n_max, n_max + 1))
    phi = F.radians("phi")
    d = blocks.join_small(spectra, angles, on).select(*keys, "phi", "re", "im").repartition(*keys)
    sums = []
    for n in ns:
        c, s = F.cos(n * phi), F.sin(n * phi)
        sums += [
            F.sum(F.col("re") * c + F.col("im") * s).alias(f"_a{n}"),
            F.sum(F.col("im") * c - F.col("re") * s).alias(f"_b{n}"),
        ]
    agg = d.groupBy(*keys).agg(*sums)
    amp2 = [(n, F.col(f"_a{n}") ** 2 + F.col(f"_b{n}") ** 2) for n in ns]
    total = amp2[0][1]
    for _, a in amp2[1:]:
        total = total + a
    return agg.select(*keys, best_of(amp2).alias("_best"), total.alias("_e")).select(
        *keys, F.col("_best.n").alias("n"), F.sqrt("_best.v").alias("amplitude"),
        (F.col("_best.v") / (F.col("_e") + TINY)).alias("quality"),
    )


def gate_mode_map(modes: DataFrame, *, n_gate: float = 0.3, n_amp_pct: float = 80.0, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """|n| where the fit is clean and among the strongest cells of its recording, NULL elsewhere."""
    floor = blocks.exact_percentile(modes, list(keys), "amplitude", min(100.0, max(0.0, n_amp_pct)) / 100.0, "_floor")
    show = (F.col("quality") >= n_gate) & (F.col("amplitude") >= F.col("_floor"))
    return blocks.join_small(modes, floor, list(keys)).withColumn("z", F.when(show, F.abs("n").cast("double"))).drop("_floor")


# ---- per-probe phase at a cursor ---------------------------------------------------------
def cursor_frames(cursors: DataFrame, frames: DataFrame, window_s: float = 0.004, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Frames averaged for each cursor: those within half a window, else five around the nearest.

    ``frames`` has one row per (recording, frame) with ``t_s`` on an even grid, ``cursors`` one row per
    (recording, slice) with ``t0``. The even grid turns the range condition into an equi-join.
    """
    keys = list(keys)
    grid = frames.groupBy(*keys).agg(
        F.min("t_s").alias("_t_first"), F.max("t_s").alias("_t_last"), F.max("frame").alias("_top"),
    ).withColumn("_step", F.when(F.col("_top") > 0, (F.col("_t_last") - F.col("_t_first")) / F.col("_top")).otherwise(1.0))
    c = blocks.join_small(cursors, grid, keys)
    lo = F.floor((F.col("t0") - window_s / 2 - F.col("_t_first")) / F.col("_step")) - 1
    hi = F.ceil((F.col("t0") + window_s / 2 - F.col("_t_first")) / F.col("_step")) + 1
    mid = F.rint((F.col("t0") - F.col("_t_first")) / F.col("_step"))

    def clamp(x):
        return F.greatest(F.lit(0), F.least(F.col("_top"), x.cast("long")))

    lo, hi = F.least(clamp(lo), clamp(mid - 3)), F.greatest(clamp(hi), clamp(mid + 5))
    cand = c.select(*cursors.columns, "_top", F.explode(F.sequence(lo, hi)).alias("frame")).join(frames.select(*keys, "frame", "t_s"), [*keys, "frame"])
    id_cols = list(cursors.columns)
    per = cand.groupBy(*id_cols, "_top").agg(
        F.count_if(F.abs(F.col("t_s") - F.col("t0")) <= window_s / 2).alias("_in"),
        F.min_by("frame", F.struct(F.abs(F.col("t_s") - F.col("t0")), "frame")).alias("_near"),
        F.collect_list(F.when(F.abs(F.col("t_s") - F.col("t0")) <= window_s / 2, F.col("frame"))).alias("_hits"),
    )
    start = F.greatest(F.lit(0).cast("long"), F.col("_near") - 2)
    fallback = F.sequence(start, F.least(F.col("_top"), start + 4))
    return per.select(*id_cols, F.explode(F.when(F.col("_in") < 3, fallback).otherwise(F.col("_hits"))).alias("frame"))


def mode_at(spectra: DataFrame, angles: DataFrame, slices: DataFrame, ref: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Phase, amplitude, coherence and errors of each probe against the reference probe.

    ``slices``: recording, slice, k and the frames to average (one row per frame). ``ref``: the
    reference channel per recording. ``angles``: recording, channel, phi.
    """
    keys = list(keys)
    on = [c for c in angles.columns if c != "phi"]
    cells = spectra.join(slices.select(*keys, "slice", "frame", "k"), [*keys, "frame", "k"])
    cells = blocks.join_small(blocks.join_small(cells, angles, on), ref.select(*keys, "ref"), keys)
    frame = Window.partitionBy(*keys, "slice", "frame")  # the probes of one frame
    is_ref = F.col("channel") == F.col("ref")
    cells = cells.withColumns({"rr": F.max(F.when(is_ref, F.col("re"))).over(frame), "ri": F.max(F.when(is_ref, F.col("im"))).over(frame)})
    avg = (
        cells.where(F.col("rr").isNotNull())
        .groupBy(*keys, "slice", "k", "channel", "phi", "ref").agg(
            F.avg(F.col("re") * F.col("rr") + F.col("im") * F.col("ri")).alias("xre"),
            F.avg(F.col("re") * F.col("ri") - F.col("im") * F.col("rr")).alias("xim"),
            F.avg(F.col("rr") ** 2 + F.col("ri") ** 2).alias("sxx"),
            F.avg(F.col("re") ** 2 + F.col("im") ** 2).alias("syy"),
            F.count(F.lit(1)).alias("n_segments"),
        )
    )
    amp = F.hypot("xre", "xim")
    d = avg.select(
        *keys, "slice", "k", "channel", "phi", amp.alias("amplitude"),
        wrap360(F.degrees(F.atan2("xim", "xre"))).alias("phase"),
        (amp * amp / (F.col("sxx") * F.col("syy") + TINY)).alias("coherence"), "n_segments",
        (F.col("channel") == F.col("ref")).alias("_is_ref"),
    )
    nan = F.lit(float("nan"))
    return d.withColumn(
        "phase_error", F.when(F.col("_is_ref"), nan).otherwise(S.phase_error("coherence", "n_segments"))
    ).withColumn(
        "amplitude_error", F.when(F.col("_is_ref"), nan).otherwise(S.amplitude_error("coherence", "amplitude", "n_segments"))
    ).drop("_is_ref")


# ---- one frequency from raw signals ------------------------------------------------------
def cursor_samples(samples: DataFrame, cursors: DataFrame, ref: DataFrame, rate: float, keys: Sequence[str] = ("shot",), bucket: int = 1 << 12) -> DataFrame:
    """Samples of each cursor's time range (both ends included, a null end open), numbered from 0, with the cursor's ``n_fft`` and ``hop``.

    The ranges are turned into index ranges on the reference channel alone; then every sample meets its cursors by
    an equi-join on buckets of ``bucket`` indices. ``n_fft`` is ``nperseg``, or all samples where there are fewer.
    """
    keys = list(keys)
    width = bucket / rate
    clock = blocks.join_small(samples, ref.withColumnRenamed("ref", "channel"), [*keys, "channel"], "left_semi").select(*keys, "i", "t_s")
    span = clock.groupBy(*keys).agg(F.min("t_s").alias("_a"), F.max("t_s").alias("_b"))
    c = blocks.join_small(cursors, span, keys).withColumns({"_lo": F.greatest("_a", F.coalesce("t_lo", "_a")), "_hi": F.least("_b", F.coalesce("t_hi", "_b"))})
    c = c.where(F.col("_lo") <= F.col("_hi")).select(*keys, "cursor", "f_hz", "nperseg", "_lo", "_hi")
    bins = F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))
    inside = clock.withColumn("_bin", F.floor(F.col("t_s") / width)).join(c.withColumn("_bin", F.explode(bins)), [*keys, "_bin"])
    ranges = inside.where(F.col("t_s").between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "cursor", "f_hz", "nperseg").agg(
        F.min("i").alias("_i0"), F.max("i").alias("_i1"))
    n_fft = F.least("nperseg", F.col("_i1") - F.col("_i0") + 1).cast("long")
    ranges = ranges.withColumns({"n_fft": n_fft, "hop": F.greatest(F.lit(1), n_fft - F.floor(n_fft / 2)).cast("long")})
    bins = F.sequence(F.floor(F.col("_i0") / bucket), F.floor(F.col("_i1") / bucket))
    met = samples.select(*keys, "channel", "i", "value").withColumn("_bin", F.floor(F.col("i") / bucket)).join(
        ranges.withColumn("_bin", F.explode(bins)), [*keys, "_bin"])
    return met.where(F.col("i").between(F.col("_i0"), F.col("_i1"))).select(
        *keys, "cursor", "channel", (F.col("i") - F.col("_i0")).alias("i"), "value", "f_hz", "n_fft", "hop")


def mode_from_signals(samples: DataFrame, angles: DataFrame, cursors: DataFrame, ref: DataFrame, rate: float, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Phase, amplitude, coherence and errors of every probe against the reference at one frequency of each cursor's range.

    ``cursors``: recording, cursor, t_lo, t_hi (s), f_hz and nperseg. A null ``f_hz`` takes the reference
    probe's own peak bin, rounded to whole hertz; zero is the mean, not a request for the peak. Spectra are Welch averages of
    half-overlapping segments; only the reference is transformed at all bins, the other probes at the cursor's
    one. The reference's own errors are NaN: it agrees with itself by construction.
    """
    keys = list(keys)
    cursor = [*keys, "cursor"]
    d = cursor_samples(samples, cursors, ref, rate, keys)
    own = blocks.join_small(d, ref.withColumnRenamed("ref", "channel"), [*keys, "channel"], "left_semi").where("f_hz is null")
    bins = spectral.stft(own, F.col("n_fft"), F.col("hop"), keys=(*cursor, "n_fft"))
    size = F.when((F.col("k") == 0) | ((F.col("n_fft") % 2 == 0) & (2 * F.col("k") == F.col("n_fft"))), 1.0).otherwise(2.0)
    power = bins.groupBy(*cursor, "n_fft", "k").agg((F.avg(F.col("re") ** 2 + F.col("im") ** 2)).alias("p")).withColumn("p", F.col("p") * size)
    peak = power.groupBy(*cursor).agg(F.rint(F.max_by(F.col("k") * rate / F.col("n_fft"), F.struct("p", -F.col("k")))).alias("peak_hz"))
    d = d.join(peak, cursor, "left").withColumn("f_hz", F.coalesce("f_hz", "peak_hz"))
    # the nearest bin, the lower one of two
    k = F.greatest(F.lit(0), F.least(F.floor(F.col("n_fft") / 2), F.ceil(F.col("f_hz") * F.col("n_fft") / rate - 0.5)))
    one = cut_lineage(spectral.stft(d.withColumn("bin", k.cast("long")), F.col("n_fft"), F.col("hop"), F.col("bin"), F.col("bin"),
                                    keys=(*cursor, "channel", "n_fft", "f_hz", "bin")))  # four readers
    pairs = blocks.join_small(one.select(*cursor, "channel").distinct(), ref, keys).select(*cursor, F.col("ref").alias("ch1"), F.col("channel").alias("ch2"))
    about = one.select(*cursor, "n_fft", F.col("f_hz").alias("asked_hz")).distinct()
    products = spectral.pair_products(one.select(*cursor, "channel", "frame", "k", "re", "im"), pairs, pair_keys=cursor).join(about, cursor)
    m = spectral.cross_spectrum(products, F.col("n_fft"), rate, (*cursor, "ch1", "ch2", "n_fft", "asked_hz"), 0.375 * F.col("n_fft"))
    is_ref, nan = F.col("ch1") == F.col("ch2"), F.lit(float("nan"))
    return blocks.join_small(m, angles.withColumnRenamed("channel", "ch2"), [c if c != "channel" else "ch2" for c in angles.columns if c != "phi"]).select(
        *cursor, F.col("ch2").alias("channel"), "phi", F.col("asked_hz").alias("f_hz"), "k", F.col("power").alias("amplitude"),
        F.when(F.col("phase") < 0, F.col("phase") + 360).otherwise(F.col("phase")).alias("phase"), "coherence", "n_segments",
        F.when(is_ref, nan).otherwise(F.col("phase_error")).alias("phase_error"),
        F.when(is_ref, nan).otherwise(F.col("amplitude_error")).alias("amplitude_error"))


# ---- circular fit -----------------------------------------------------------------------
def circular_fit(mode: DataFrame, keys: Sequence[str], n_range: tuple[int, int] = (-6, 6), weights: str = "amplitude") -> DataFrame:
    """Integer n whose residual phase + n*phi clusters best on the circle, with its posterior.

    A key is one slice's probes, at most the channels of a recording. One shuffle by key serves both
    passes: windows give the weighted resultant of each candidate, the following aggregation the
    chi-square around each candidate's intercept. Candidates are columns; no row is multiplied.
    Bad weights count as zero, all-zero weights as uniform; missing sigmas take the median.
    """
    if n_range[1] < n_range[0]:
        raise ValueError(f"no mode number lies between {n_range[0]} and {n_range[1]}")
    keys = list(keys)
    ns = list(range(n_range[0], n_range[1] + 1))
    group = Window.partitionBy(*keys)
    sig = F.col("phase_error").cast("double") if "phase_error" in mode.columns else F.lit(None).cast("double")
    raw = F.lit(1.0) if weights == "uniform" else F.col("coherence" if weights == "coherence" else "amplitude").cast("double")
    bad = raw.isNull() | F.isnan(raw) | (raw == float("inf")) | (raw < 0)
    d = mode.select(*keys, "phase", "phi", F.when(bad, 0.0).otherwise(raw).alias("_raw"), F.when(~F.isnan(sig) & (sig > 0), sig).alias("_sig"))
    d = d.withColumn("w", F.when(F.max("_raw").over(group) > 0, F.col("_raw")).otherwise(1.0))
    d = d.withColumn("_sig", F.coalesce("_sig", F.median("_sig").over(group), F.lit(1.0)))
    sums = {"_w": F.sum("w").over(group)}
    for j, n in enumerate(ns):
        a = F.radians(F.col("phase") + n * F.col("phi"))
        sums |= {f"_c{j}": F.sum(F.col("w") * F.cos(a)).over(group), f"_s{j}": F.sum(F.col("w") * F.sin(a)).over(group)}
    d = d.withColumns(sums)
    icpt = [F.degrees(F.atan2(F.col(f"_s{j}"), F.col(f"_c{j}"))) for j in range(len(ns))]
    aggs = [F.first("_w").alias("_w"), F.count(F.lit(1)).alias("n_probes"), F.sum(1.0 / (F.col("_sig") * F.col("_sig"))).alias("_iv")]
    for j, n in enumerate(ns):
        aggs += [F.first(f"_c{j}").alias(f"_c{j}"), F.first(f"_s{j}").alias(f"_s{j}"),
                 F.sum((wrap180(F.col("phase") + n * F.col("phi") - icpt[j]) / F.col("_sig")) ** 2).alias(f"_x{j}")]
    g = d.groupBy(*keys).agg(*aggs)
    best = best_of([(j, F.hypot(F.col(f"_c{j}"), F.col(f"_s{j}")) / F.col("_w")) for j in range(len(ns))])
    g = g.select(*keys, "n_probes", "_iv", F.array(*icpt).alias("_icpt"), best.alias("_best"), F.array(*[F.col(f"_x{j}") for j in range(len(ns))]).alias("_chi"))
    g = g.withColumn("_post", F.transform("_chi", lambda x: F.exp(-(x - F.array_min("_chi")) / 2.0)))
    j, weight_sum = F.col("_best.n"), F.aggregate("_post", F.lit(0.0), lambda a, x: a + x)
    return g.select(
        *keys, (j + ns[0]).cast("int").alias("n"), wrap360(F.get("_icpt", j)).alias("intercept_deg"),
        F.col("_best.v").alias("resultant"), F.sqrt(1.0 / F.col("_iv")).alias("phase_sigma"),
        (F.get("_post", j) / weight_sum).alias("n_confidence"), "n_probes",
    )


# ---- shape similarity --------------------------------------------------------------------
def shape_vector(mode: DataFrame) -> DataFrame:
    """amplitude * exp(i phase) as re, im."""
    p = F.radians("phase")
    return mode.withColumn("re", F.col("amplitude") * F.cos(p)).withColumn("im", F.col("amplitude") * F.sin(p))


def mac_sums(v_re, v_im, w_re, w_im) -> list[Column]:
    a, b, c, d = (_col(x) for x in (v_re, v_im, w_re, w_im))
    return [
        F.sum(a * c + b * d).alias("_xr"), F.sum(a * d - b * c).alias("_xi"),
        F.sum(a * a + b * b).alias("_vv"), F.sum(c * c + d * d).alias("_ww"),
    ]


def mac_value() -> Column:
    den = F.col("_vv") * F.col("_ww")
    return F.when(den > 0, (F.col("_xr") ** 2 + F.col("_xi") ** 2) / den).otherwise(0.0)


def mac(left: DataFrame, right: DataFrame, probe: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Similarity in [0, 1] of two complex shapes, insensitive to a complex scale.

    ``left`` carries the result keys, ``right`` (columns w_re, w_im) joins on ``probe``.
    """
    return left.join(right, list(probe)).groupBy(*keys).agg(*mac_sums("re", "im", "w_re", "w_im")).select(*keys, mac_value().alias("mac"))


def mac_templates(shapes: DataFrame, keys: Sequence[str], n_range: tuple[int, int] = (-6, 6)) -> DataFrame:
    """MAC against pure patterns exp(-i n phi) for each candidate, and the best n, per key."""
    keys = list(keys)
    ns = list(range(n_range[0], n_range[1] + 1))
    phi = F.radians("phi")
    aggs = [F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("_vv"), F.count(F.lit(1)).alias("_p")]
    for j, n in enumerate(ns):
        c, s = F.cos(n * phi), F.sin(n * phi)
        aggs += [F.sum(F.col("re") * c - F.col("im") * s).alias(f"_r{j}"), F.sum(-F.col("re") * s - F.col("im") * c).alias(f"_i{j}")]
    agg = shapes.groupBy(*keys).agg(*aggs)
    den = F.col("_vv") * F.col("_p")
    macs = [F.when(den > 0, (F.col(f"_r{j}") ** 2 + F.col(f"_i{j}") ** 2) / den).otherwise(0.0) for j in range(len(ns))]
    return agg.select(
        *keys, F.array(*[F.struct(F.lit(n).alias("n"), m.alias("mac")) for n, m in zip(ns, macs)]).alias("spectrum"),
        best_of(list(zip(ns, macs))).alias("_b"),
    ).select(*keys, "spectrum", F.col("_b.n").alias("best_n"), F.col("_b.v").alias("best_mac"))


# ---- tracks over time ----------------------------------------------------------------------
def frame_power(spectra: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    return spectra.groupBy(*keys, "frame").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def active_window(spectra: DataFrame, frames: DataFrame, *, power_floor_frac: float = 0.1, pad_frac: float = 0.05,
                  keys: Sequence[str] = ("shot",)) -> DataFrame:
    """[t_lo, t_hi] where the band power of the array exceeds a share of its peak, padded."""
    keys = list(keys)
    p = frame_power(spectra, keys).join(frames.select(*keys, "frame", "t_s"), [*keys, "frame"])
    peak = p.groupBy(*keys).agg(F.max("power").alias("_peak"), F.min("t_s").alias("_t0"), F.max("t_s").alias("_t1"))
    on = (F.col("_peak") <= 0) | (F.col("power") >= power_floor_frac * F.col("_peak"))
    span = blocks.join_small(p, peak, keys).where(on).groupBy(*keys, "_t0", "_t1", "_peak").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b"))
    pad = F.when(F.col("_peak") > 0, pad_frac * (F.col("b") - F.col("a"))).otherwise(0.0)
    return span.select(*keys, F.greatest(F.col("_t0"), F.col("a") - pad).alias("t_lo"), F.least(F.col("_t1"), F.col("b") + pad).alias("t_hi"))


def even_slices(bounds: DataFrame, n_slices: int, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Unique truncated evenly spaced indices in [lo, hi], both ends included."""
    count = F.least(F.lit(n_slices).cast("long"), F.col("hi") - F.col("lo") + 1)
    step = F.when(count > 1, (F.col("hi") - F.col("lo")) / (count - 1)).otherwise(0.0)
    return bounds.select(*keys, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0).cast("long"), count - 1),
        lambda j: F.when((count > 1) & (j == count - 1), F.col("hi")).otherwise(F.floor(F.col("lo") + j * step).cast("long")),
    ))).alias("frame"))


def frames_in_window(frames: DataFrame, window: DataFrame | None, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """First and last frame inside the window; a window with fewer than two frames gives all."""
    keys = list(keys)
    if window is None:
        return frames.groupBy(*keys).agg(F.lit(0).cast("long").alias("lo"), F.max("frame").alias("hi"))
    inside = F.col("t_s").between(F.col("t_lo"), F.col("t_hi"))
    d = blocks.join_small(frames, window, keys).groupBy(*keys).agg(
        F.count_if(inside).alias("_n"), F.min(F.when(inside, F.col("frame"))).alias("_lo"),
        F.max(F.when(inside, F.col("frame"))).alias("_hi"), F.max("frame").alias("_top"),
    )
    ok = F.col("_n") >= 2
    return d.select(*keys, F.when(ok, F.col("_lo")).otherwise(F.lit(0)).cast("long").alias("lo"), F.when(ok, F.col("_hi")).otherwise(F.col("_top")).alias("hi"))


def dominant_bin(spectra: DataFrame, slices: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Strongest bin of the array at each slice's own frame; ties go to the lower bin."""
    keys = list(keys)
    cells = spectra.join(slices.select(*keys, "frame"), [*keys, "frame"]).groupBy(*keys, "frame", "k").agg(
        F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("p"))
    return cells.groupBy(*keys, "frame").agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("k"))


def strongest_slice(mode: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """The slice with the largest summed amplitude; ties go to the earliest."""
    s = mode.groupBy(*keys, "slice").agg(F.sum("amplitude").alias("strength"))
    return s.groupBy(*keys).agg(F.max_by("slice", F.struct("strength", -F.col("slice"))).alias("ref_slice"))


def track(mode: DataFrame, *, keys: Sequence[str] = ("shot",), n_range: tuple[int, int] = (-6, 6), ref: DataFrame | None = None) -> DataFrame:
    """n and similarity to the reference slice for every slice at once."""
    keys = list(keys)
    shapes = shape_vector(mode)
    ref = strongest_slice(mode, keys) if ref is None else ref
    base = shapes.join(ref, keys).where(F.col("slice") == F.col("ref_slice")).select(
        *keys, "channel", "ref_slice", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    sim = mac(shapes, base, [*keys, "channel"], [*keys, "slice", "ref_slice"])
    return sim.join(circular_fit(mode, [*keys, "slice"], n_range).select(*keys, "slice", "n"), [*keys, "slice"])


def dominant_mode(tracked: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Most frequent n; ties go to the lowest."""
    c = tracked.groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("cnt"))
    return c.groupBy(*keys).agg(F.max_by("n", F.struct("cnt", -F.col("n"))).alias("dominant_n"))


def auto_frequency(spec: DataFrame, keys: Sequence[str] = ("shot",), f_lo: float = 1e3, f_hi: float = 25e3,
                   at: DataFrame | None = None, fallback_khz: float = 5.0) -> DataFrame:
    """Peak-power frequency in a band, of the time mean or at the frame nearest ``at.t0``; whole kHz."""
    keys = list(keys)
    d = spec
    if at is not None:
        near = spec.select(*keys, "frame", "t_s").distinct().join(at, keys).groupBy(*keys).agg(
            F.min_by("frame", F.struct(F.abs(F.col("t_s") - F.col("t0")), "frame")).alias("frame"))
        d = spec.join(near, [*keys, "frame"])
    inside = d.where(F.col("f_hz").between(f_lo, f_hi)).groupBy(*keys, "k", "f_hz").agg(F.avg("power").alias("p"))
    peak = inside.groupBy(*keys).agg(F.max_by("f_hz", F.struct("p", -F.col("k"))).alias("f"))
    return spec.select(*keys).distinct().join(peak, keys, "left").select(
        *keys, F.coalesce(F.rint(F.col("f") / 1e3), F.lit(fallback_khz)).alias("f_khz"))


def wrapped_ramp(fits: DataFrame, keys: Sequence[str], points: int = 361) -> DataFrame:
    """Fitted line (c - n a) mod 360 with a NULL break wherever it wraps."""
    keys = list(keys)
    grid = fits.select(*keys, "n", "intercept_deg", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("o"))
    step = 360.0 / (points - 1)

    def line(o: Column) -> Column:
        return wrap360(F.col("intercept_deg") - F.col("n") * (o * step))

    y, prev = line(F.col("o")), line(F.col("o") - 1)
    jump = (F.col("o") > 0) & (F.abs(y - prev) > 180.0)
    point = F.struct((2 * F.col("o") + 1).alias("ord"), F.round(F.col("o") * step, 1).alias("x"), F.round(y, 1).alias("y"))
    gap = F.struct((2 * F.col("o")).alias("ord"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    return grid.select(*keys, F.inline(F.when(jump, F.array(gap, point)).otherwise(F.array(point))))
