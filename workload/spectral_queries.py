"""Spectra, cross spectra, coherence, gates and smoothing."""
from __future__ import annotations

from pyspark.sql import functions as F

from ringwave.functions import tables
from ringwave.operators import blocks, modes, spectra, summaries
from ringwave.session import cut_lineage
from workload.inputs import (DT, EV, HOP, LI, LINE_SPECTRA, N_FFT, PAIRS, event_samples, line_angles, line_samples,
                             spectrum_sql, stacked_lines)
from workload.registry import out, query, r

FS = 1e5
DF = FS / N_FFT
BINS = N_FFT // 2 + 1  # bins 0..32; at the two real-valued ones a phase is 0 or 180


def line_spectra(spark, sf):
    return spectra.stft(stacked_lines(spark, sf), N_FFT, HOP)


def pair_table(spark, sf):
    a = line_angles(spark, sf).where(F.col("channel") != "p1")
    return a.select(F.lit("p1").alias("ch1"), F.col("channel").alias("ch2"), F.col("phi").alias("delta_phi"))


def products(spark, sf):
    s = cut_lineage(spectra.stft_frames(stacked_lines(spark, sf), N_FFT, HOP))
    pairs = s.select("shot", F.col("channel").alias("ch2")).distinct().join(pair_table(spark, sf), "ch2")
    return spectra.pair_products_of_frames(s, pairs)


def pair_spectrogram(spark, sf):
    """All six pairs with the reference probe, all bins."""
    return spectra.spectrogram(products(spark, sf), BINS, 5)


PAIR = ("shot", "ch2")


# ---- framing and transforms -------------------------------------------------------------------
@query("frames", f"""with {LI}, lay as (select shot, n, 64 as n_fft,
  case when greatest(1, (n - 64) // 32 + 1) > 40 then greatest(32, (n - 64) // 39) else 32 end as hop from ln)
select li.shot, channel, frame, count(*) as n_samples, {r('sum(value)', 6)} as total
from li join lay using (shot), range(0, 41) t(frame)
where frame <= (lay.n - n_fft) // hop and i >= frame * hop and i < frame * hop + n_fft
group by all""")
def frames(spark, sf):
    d = stacked_lines(spark, sf)
    clock = d.groupBy("shot").agg((F.max("i") + 1).alias("n")).withColumn("dt", F.lit(DT))
    lay = spectra.layout(clock, N_FFT * DT, 40)
    f = spectra.explode_frames(blocks.join_small(d, lay.select("shot", "n_fft", "hop"), "shot"), "n_fft", "hop")
    g = f.groupBy("shot", "channel", "n_fft", "frame").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("value").alias("total"))
    return out(g.where(F.col("n_samples") == F.col("n_fft")).drop("n_fft"))


@query("frames_uncapped", f"""with {LI}
select shot, channel, frame, count(*) as n_samples, {r('sum(value)', 6)} as total
from (select shot, channel, i, value, n, unnest([i // 32 - 1, i // 32]) as frame from li)
where frame >= 0 and frame <= (n - 64) // 32 group by all""")
def frames_uncapped(spark, sf):
    """Every sample of every channel in its frames, without a column cap."""
    f = spectra.explode_frames(stacked_lines(spark, sf), N_FFT, HOP)
    g = f.groupBy("shot", "channel", "frame").agg(F.count(F.lit(1)).alias("n_samples"), F.sum("value").alias("total"))
    return out(g.where(F.col("n_samples") == N_FFT))


@query("frames_sql", f"""with {LI}
select shot, channel, frame, count(*) as n_samples, {r('sum(value)', 6)} as total
from (select shot, channel, i, value, n, unnest([i // 32 - 1, i // 32]) as frame from li)
where frame >= 0 and frame <= (n - 64) // 32 group by all""")
def frames_sql(spark, sf):
    """The same frames by the table function of SQL."""
    tables.register_table_functions(spark)
    parts = tables.framing_parts(stacked_lines(spark, sf), N_FFT, HOP)
    f = spark.sql(f"""select shot, channel, frame, cast(size(samples) as bigint) as n_samples, aggregate(samples, 0D, (a, x) -> a + x) as total
      from frames(table(select shot, channel, part, i, value from {{parts}}) partition by (shot, channel, part) order by (i), {N_FFT}, {HOP})""", parts=parts)
    return out(f)


@query("stft_full", f"with {LINE_SPECTRA} select shot, channel, frame, k, {r('re')} as re, {r('im')} as im from ls")
def stft_full(spark, sf):
    return out(line_spectra(spark, sf))


@query("stft_band", f"with {EV}, {spectrum_sql('ev', 16, 8, 1, 4, 'es')} select shot, channel, frame, k, {r('re')} as re, {r('im')} as im from es")
def stft_band(spark, sf):
    return out(spectra.stft_band(event_samples(spark, sf), 16, 8, range(1, 5)))


@query("median_step", f"""with {EV}, d as (select shot, channel, t_real - lag(t_real) over (partition by shot, channel order by i) as s from ev)
select shot, channel, {r('quantile_cont(abs(s), 0.5)')} as dt from d where s is not null group by all""")
def median_step(spark, sf):
    return out(spectra.median_step(event_samples(spark, sf), ["shot", "channel"], axis="t_real"))


# ---- two-probe analysis ---------------------------------------------------------------------------
CROSS = f"""{PAIRS},
agg as (select shot, ch2, line, k, avg(xre) as xr, avg(xim) as xi, avg(p1) as p1, avg(p2) as p2, count(*) as n_segments from lx group by all),
wp as (select sum((0.5 - 0.5 * cos(2 * pi() * j / 64)) ** 2) as u from range(0, 64) t(j)),
cs as (select shot, ch2, line, k, n_segments, (line - 1) * 360 / 7 as delta, sqrt(xr * xr + xi * xi) * case when k in (0, 32) then 1 else 2 end / (1e5 * u) as power,
  (xr * xr + xi * xi) / (p1 * p2) as coherence, degrees(atan2(xi, xr)) as phase,
  greatest(1e-3, sqrt((xr * xr + xi * xi) / (p1 * p2))) as g from agg, wp)"""


@query("cross_spectrum", f"""with {CROSS} select shot, ch2, k, {r('k * 1e5 / 64')} as f_hz, {r('power * 1e3')} as power, {r('coherence')} as coherence,
  {r('phase')} as phase, n_segments, {r('least(180, degrees(sqrt(1 - g * g) / (g * sqrt(2 * n_segments))))')} as phase_error,
  {r('1e3 * power / (g * sqrt(n_segments))')} as amplitude_error, cast(round_even(phase / delta, 0) as int) as n from cs""")
def cross_spectrum(spark, sf):
    d = spectra.cross_spectrum(products(spark, sf), N_FFT, FS).drop("ch1", "delta_phi")
    return out(d.withColumns({"power": F.col("power") * 1e3, "amplitude_error": F.col("amplitude_error") * 1e3}))


@query("welch_segments", f"""with {LI}, c as (select shot, channel, count(*) as n from li0 group by all)
select shot, channel, n, greatest(1, 1 + (n - least(256, n)) // greatest(1, least(256, n) - least(256, n) // 2)) as n_segments from c""")
def welch_segments(spark, sf):
    from ringwave.functions.spectral import welch_segments as segments

    c = line_samples(spark, sf).groupBy("shot", "channel").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("n_segments", segments("n", F.lit(256)))


@query("rms_by_mode", f"""with {CROSS}, lim as (select shot, ch2, cast(floor(ceil(180 / abs(delta) - 0.5) * 2 / 2) as int) as m from cs group by all),
grid as (select shot, ch2, unnest(range(-m, m + 1)) as n from lim),
s as (select shot, ch2, cast(round_even(phase / delta, 0) as int) as n, sum(power) as p from cs group by all)
select g.shot, g.ch2, g.n, {r('sqrt(coalesce(p, 0) * 1562.5)')} as rms from grid g left join s on g.shot = s.shot and g.ch2 = s.ch2 and g.n = s.n""")
def rms_by_mode(spark, sf):
    cs = spectra.cross_spectrum(products(spark, sf), N_FFT, FS)
    return out(spectra.rms_by_mode(cs, ["shot", "ch2"], F.lit(DF)).withColumn("n", F.col("n").cast("long")))


# ---- spectrogram -----------------------------------------------------------------------------------
SPEC = f"""{PAIRS},
wide as (select p.shot, p.ch2, p.line, p.frame, p.k, p.xre, p.xim, p.p1, p.p2,
   q.xre as sx, q.xim as sy, q.p1 as s1, q.p2 as s2
   from lx p, range(-2, 3) t(o) join lx q on q.shot = p.shot and q.ch2 = p.ch2 and q.frame = p.frame
    and q.k = (case when p.k + o < 0 then -1 - (p.k + o) when p.k + o > 32 then 65 - (p.k + o) else p.k + o end)),
sg as (select shot, ch2, line, frame, k, sqrt(any_value(xre) ** 2 + any_value(xim) ** 2) as power,
   degrees(atan2(any_value(xim), any_value(xre))) as phase,
   greatest(0, least(1, (avg(sx) ** 2 + avg(sy) ** 2) / (avg(s1) * avg(s2)))) as coherence from wide group by all),
sn as (select *, (line - 1) * 360 / 7 as delta, cast(round_even(phase / ((line - 1) * 360 / 7), 0) as int) as n from sg)"""


@query("coherence_smoothed", f"with {SPEC} select shot, ch2, frame, k, {r('power')} as power, {r('coherence')} as coherence, n from sn")
def coherence_smoothed(spark, sf):
    return out(pair_spectrogram(spark, sf).select(*PAIR, "frame", "k", "power", "coherence", "n"))


DENOISED = f"""{SPEC}, fl as (select shot, ch2, k, quantile_cont(power, 0.5) as f from sn group by all),
dn as (select sn.shot, sn.ch2, delta, frame, sn.k, coherence, n, case when coherence >= 0.3 and power >= 1.2 * f then power else 0 end as power
  from sn join fl on sn.shot = fl.shot and sn.ch2 = fl.ch2 and sn.k = fl.k)"""


def denoised(s):
    return spectra.denoise(s, coherence_min=0.3, power_floor_k=1.2, keys=PAIR)


@query("spectrogram_denoised", f"""with {DENOISED} select shot, ch2, frame, k, {r('power')} as power,
  {r('case when power = 0 then null else log10(greatest(power, 1e-30)) end')} as z from dn""")
def spectrogram_denoised(spark, sf):
    d = denoised(cut_lineage(pair_spectrogram(spark, sf)))
    return out(d.select(*PAIR, "frame", "k", "power", spectra.log_power().alias("z")))


@query("n_spectrum", f"""with {DENOISED}, cells as (select distinct shot, ch2, frame, cast(floor(ceil(180 / abs(delta) - 0.5) * 2 / 2) as int) as m from dn),
s as (select shot, ch2, frame, n, sum(power) as p from dn group by all),
g as (select shot, ch2, frame, unnest(range(-m, m + 1)) as n from cells)
select g.shot, g.ch2, g.frame, g.n, {r('sqrt(coalesce(p, 0) * 1562.5)')} as rms
from g left join s on s.shot = g.shot and s.ch2 = g.ch2 and s.frame = g.frame and s.n = g.n""")
def n_spectrum(spark, sf):
    d = denoised(cut_lineage(pair_spectrogram(spark, sf)))
    return out(spectra.rms_by_mode(d, [*PAIR, "frame"], F.lit(DF)).withColumn("n", F.col("n").cast("long")))


@query("gate_retention", f"""with {DENOISED} select dn.shot, dn.ch2, {r('count(*) filter (dn.power > 0) / count(*)')} as cells_kept,
  {r('sum(dn.power) / sum(sn.power)')} as power_kept from dn join sn using (shot, ch2, frame, k) group by dn.shot, dn.ch2""")
def gate_retention(spark, sf):
    s = cut_lineage(pair_spectrogram(spark, sf))
    return out(spectra.gate_retention(denoised(s), s, [*PAIR, "frame", "k"], PAIR))


def _smooth_sql(src: str, cols: list[str], final: str, key: str = "shot") -> str:
    """Separable Gaussian with sigma 1 over frames and bins with mirrored edges."""
    keys = [k.strip() for k in key.split(",")]
    a_key, same = ", ".join(f"a.{k}" for k in keys), " and ".join(f"b.{k} = a.{k}" for k in keys)
    mirror = "least({p}, 2 * {n} - 1 - {p})"
    pf = "(((a.frame + o) % (2 * nf)) + 2 * nf) % (2 * nf)"
    pk = "(((a.k + o) % 66) + 66) % 66"
    first = ", ".join(f"sum(w * b.{c}) as {c}" for c in cols)
    return f"""taps as (select o, exp(-0.5 * o * o) / (select sum(exp(-0.5 * q * q)) from range(-4, 5) t(q)) as w from range(-4, 5) t(o)),
nfr as (select {key}, max(frame) + 1 as nf from {src} group by {key}),
tm as (select {a_key}, a.frame, a.k, {first} from {src} a join nfr using ({key}), taps
  join {src} b on {same} and b.k = a.k and b.frame = {mirror.format(p=pf, n='nf')} group by all),
{final} as (select {a_key}, a.frame, a.k, {first} from tm a, taps
  join tm b on {same} and b.frame = a.frame and b.k = {mirror.format(p=pk, n='33')} group by all)"""


@query("spectrogram_smoothed", f"""with {SPEC}, lg as (select shot, ch2, frame, k, log10(greatest(power, 1e-30)) as lp, coherence from sn),
{_smooth_sql('lg', ['lp', 'coherence'], 'sm', 'shot, ch2')}
select shot, ch2, frame, k, {r('10 ** lp')} as power, {r('coherence')} as coherence from sm""")
def spectrogram_smoothed(spark, sf):
    s = pair_spectrogram(spark, sf).select(*PAIR, "frame", "k", "power", "coherence")
    return out(spectra.smooth_spectrogram(s, sigma_time_bins=1.0, sigma_freq_bins=1.0, keys=PAIR))


@query("auto_frequency", f"""with {SPEC}, m as (select shot, ch2, k, avg(power) as p from sn where k * 1562.5 between 1000 and 25000 group by all),
b as (select *, row_number() over (partition by shot, ch2 order by p desc, k) as rn from m)
select shot, ch2, round_even(k * 1562.5 / 1000, 0) as f_khz from b where rn = 1""")
def auto_frequency(spark, sf):
    s = cut_lineage(pair_spectrogram(spark, sf)).withColumn("f_hz", F.col("k") * DF)
    return modes.auto_frequency(s, keys=PAIR)


@query("band_percentile_gate", f"""with {SPEC}, col as (select * from sn where frame = 5), f as (select shot, ch2, quantile_cont(power, 0.6) as fl from col group by shot, ch2)
select shot, ch2, k, {r('power')} as power, case when power >= fl then abs(n) else 0 end as n from col join f using (shot, ch2)""")
def band_percentile_gate(spark, sf):
    """The time column nearest a cursor with the mode numbers below a power percentile zeroed."""
    s = cut_lineage(pair_spectrogram(spark, sf))
    t0 = s.select("shot").distinct().withColumn("t0", F.lit((5 * HOP + N_FFT / 2) * DT))
    s = s.withColumn("t_s", (F.col("frame") * HOP + N_FFT / 2) * DT)
    near = s.select("shot", "frame", "t_s").distinct().join(t0, "shot").groupBy("shot").agg(F.min_by("frame", F.struct(F.abs(F.col("t_s") - F.col("t0")), "frame")).alias("frame"))
    col = blocks.join_small(s, near, ["shot", "frame"])
    floor = summaries.percentile_or_empty(col, list(PAIR), "power", 60.0, "fl")
    d = col.join(floor, list(PAIR)).select(*PAIR, "k", "power", F.when(F.col("power") >= F.col("fl"), F.abs("n")).otherwise(0).alias("n"))
    return out(d)


@query("column_levels", f"""with {LI}, caps as (select unnest([10, 20, 40]) as cap, unnest([0, 1, 2]) as level),
lay as (select shot, n, level, case when (n - 64) // 32 + 1 > cap then greatest(32, (n - 64) // (cap - 1)) else 32 end as hop from ln, caps)
select level, shot, channel, frame, {r('sum(value)', 6)} as total, any_value(hop)::bigint as hop, level = 2 as final
from li join lay using (shot), range(0, 41) t(frame)
where frame <= (lay.n - 64) // hop and i >= frame * hop and i < frame * hop + 64 group by all""")
def column_levels(spark, sf):
    """Coarse-to-fine frame sums with a growing column cap, the level's feature; ``hop`` shows what it skips."""
    d = cut_lineage(stacked_lines(spark, sf))

    def build(s, cap):
        clock = s.groupBy("shot").agg((F.max("i") + 1).alias("n")).withColumn("dt", F.lit(DT))
        lay = spectra.layout(clock, N_FFT * DT, cap)
        f = spectra.explode_frames(blocks.join_small(s, lay.select("shot", "n_fft", "hop"), "shot"), "n_fft", "hop")
        g = f.groupBy("shot", "channel", "n_fft", "hop", "frame").agg(F.count(F.lit(1)).alias("c"), F.sum("value").alias("total"))
        return g.where(F.col("c") == F.col("n_fft")).select("shot", "channel", "frame", "hop", "total")

    return out(spectra.spectrogram_levels(d, build, [10, 20, 40]).select("level", "shot", "channel", "frame", "total", "hop", "final"))
