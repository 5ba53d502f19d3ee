"""Array mode numbers, circular fits, similarity and tracks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.operators import blocks, modes, shape, spectra
from ringwave.session import cut_lineage
from workload.inputs import DT, HOP, LI, LINE_SPECTRA, N_FFT, R32, line_angles, ring32, stacked_lines, table
from workload.registry import out, query, r
from workload.spectral_queries import _smooth_sql, line_spectra

PHI = "((cast(substr(channel, 2) as int) - 1) * 2 * pi() / 7)"
N_RANGE = (-3, 3)  # seven even probes cannot tell more apart

MAP = f"""{LINE_SPECTRA},
pr as (select shot, frame, k, n, sum(re * cos(n * {PHI}) + im * sin(n * {PHI})) as a, sum(im * cos(n * {PHI}) - re * sin(n * {PHI})) as b
  from ls, range(-3, 4) t(n) group by all),
pk as (select *, a * a + b * b as e, sum(a * a + b * b) over (partition by shot, frame, k) as tot,
  row_number() over (partition by shot, frame, k order by a * a + b * b desc, n) as rn from pr),
mm as (select shot, frame, k, case when k in (0, 32) then abs(n) else n end as n, sqrt(e) as amplitude, e / (tot + 1e-30) as quality from pk where rn = 1)"""


def line_map(spark, sf):
    """All bins; a real-valued spectrum cannot tell n from -n, so the two real bins give the size of n."""
    m = modes.mode_map(line_spectra(spark, sf), line_angles(spark, sf), 3)
    return m.withColumn("n", F.when(F.col("k").isin(0, N_FFT // 2), F.abs("n")).otherwise(F.col("n")))


@query("mode_map", f"with {MAP} select shot, frame, k, n, {r('amplitude')} as amplitude, {r('quality')} as quality from mm")
def mode_map(spark, sf):
    return out(line_map(spark, sf).withColumn("n", F.col("n").cast("long")))


@query("mode_map_gated", f"""with {MAP}, fl as (select shot, quantile_cont(amplitude, 0.8) as f from mm group by shot)
select shot, frame, k, case when quality >= 0.3 and amplitude >= f then abs(n)::double end as z from mm join fl using (shot)""")
def mode_map_gated(spark, sf):
    return modes.gate_mode_map(cut_lineage(line_map(spark, sf))).select("shot", "frame", "k", "z")


@query("mode_map_smoothed", f"""with {MAP}, {_smooth_sql('mm', ['quality', 'amplitude'], 'sm')}
select sm.shot, sm.frame, sm.k, mm.n, {r('sm.quality')} as quality, {r('sm.amplitude')} as amplitude from sm join mm using (shot, frame, k)""")
def mode_map_smoothed(spark, sf):
    m = line_map(spark, sf)
    m = spectra.smooth_axis(m, ["shot", "k"], "frame", ["quality", "amplitude"], 1.0)
    m = spectra.smooth_axis(m, ["shot", "frame"], "k", ["quality", "amplitude"], 1.0)
    return out(m.select("shot", "frame", "k", F.col("n").cast("long").alias("n"), "quality", "amplitude"))


# ---- cursors ---------------------------------------------------------------------------------------
def _cursor_sql(window: float) -> str:
    t = "({f} * 32 * 1e-5 + 32 * 1e-5)"
    return f"""{LINE_SPECTRA},
fr as (select distinct shot, frame, {t.format(f='frame')} as t_s from ls),
top as (select shot, max(frame) as hi from fr group by shot),
sl as (select distinct shot, hi, case when j = 9 then hi else cast(floor(j * (hi / 9)) as bigint) end as slice from top, range(0, 10) t(j)),
bin as (select s.shot, s.slice, k, row_number() over (partition by s.shot, s.slice order by sum(re * re + im * im) desc, k) as rn
  from sl s join ls on ls.shot = s.shot and ls.frame = s.slice where k between 1 and 31 group by s.shot, s.slice, k),
near as (select s.shot, s.slice, s.hi, count(*) filter (abs(f.t_s - {t.format(f='s.slice')}) <= {window} / 2) as hits
  from sl s join fr f on f.shot = s.shot group by all),
sel as (select n.shot, n.slice, f.frame from near n join fr f on f.shot = n.shot
  where case when hits >= 3 then abs(f.t_s - {t.format(f='n.slice')}) <= {window} / 2
        else f.frame between greatest(0, n.slice - 2) and least(n.hi, greatest(0, n.slice - 2) + 4) end),
cell as (select s.shot, s.slice, s.frame, ls.channel, ls.k, ls.re, ls.im from sel s join bin b on b.shot = s.shot and b.slice = s.slice and b.rn = 1
  join ls on ls.shot = s.shot and ls.frame = s.frame and ls.k = b.k),
av as (select a.shot, a.slice, a.k, a.channel, avg(a.re * b.re + a.im * b.im) as xr, avg(a.re * b.im - a.im * b.re) as xi,
  avg(b.re ** 2 + b.im ** 2) as sxx, avg(a.re ** 2 + a.im ** 2) as syy, count(*) as n_segments
  from cell a join cell b on a.shot = b.shot and a.slice = b.slice and a.frame = b.frame and b.channel = 'p1' group by all),
ma0 as (select *, sqrt(xr * xr + xi * xi) as amplitude, (cast(substr(channel, 2) as int) - 1) * 360 / 7 as phi,
  case when degrees(atan2(xi, xr)) < 0 then degrees(atan2(xi, xr)) + 360 else degrees(atan2(xi, xr)) end as phase,
  (xr * xr + xi * xi) / (sxx * syy + 1e-30) as coherence from av),
ma as (select *, greatest(1e-3, least(1, sqrt(coherence))) as g from ma0)"""


ERRORS = """case when channel = 'p1' then null else least(180, degrees(sqrt(greatest(0, 1 - g * g)) / (g * sqrt(2 * n_segments)))) end"""


def cursor_mode(spark, sf, window):
    d = cut_lineage(stacked_lines(spark, sf))
    s = cut_lineage(spectra.stft(d, N_FFT, HOP))
    frames = spectra.frame_times(d.where(F.col("channel") == "p1"), N_FFT, HOP, DT)
    frames = blocks.join_small(frames, s.groupBy("shot").agg(F.max("frame").alias("_top")), "shot").where(F.col("frame") <= F.col("_top")).drop("_top")
    sl = modes.even_slices(modes.frames_in_window(frames, None), 10).join(frames, ["shot", "frame"])
    cursors = sl.select("shot", F.col("frame").alias("slice"), F.col("t_s").alias("t0"))
    phased = s.where(F.col("k").between(1, N_FFT // 2 - 1))  # a mode needs a phase, which real bins lack
    k = modes.dominant_bin(phased, sl).select("shot", F.col("frame").alias("slice"), "k")
    picked = modes.cursor_frames(cursors, frames, window).join(k, ["shot", "slice"])
    ref = s.select("shot").distinct().withColumn("ref", F.lit("p1"))
    return cut_lineage(modes.mode_at(s, line_angles(spark, sf), picked, ref)), s, frames


def _cursor_query(name, window):
    @query(name, f"""with {_cursor_sql(window)} select shot, slice, k, channel, {r('phase')} as phase, {r('amplitude')} as amplitude,
      {r('coherence')} as coherence, {r(ERRORS)} as phase_error, n_segments from ma""")
    def run(spark, sf):
        m, _, _ = cursor_mode(spark, sf, window)
        m = m.select("shot", "slice", "k", "channel", "phase", "amplitude", "coherence", "phase_error", "n_segments")
        m = m.withColumn("phase_error", F.when(~F.isnan("phase_error"), F.col("phase_error")))
        return out(m.withColumn("phase", F.when(F.abs(F.col("phase") - 360) < 1e-9, 0.0).otherwise(F.col("phase"))))

    return run


_cursor_query("mode_at_frequency", 0.004)
_cursor_query("mode_at_frequency_few_frames", 0.0003)

FIT = f"""{_cursor_sql(0.004)},
w as (select shot, slice, channel, phase, phi, amplitude, {ERRORS} as se0 from ma),
md as (select shot, slice, median(se0) as fill, sum(amplitude) as aw from w where true group by all),
ws as (select w.*, coalesce(case when se0 > 0 then se0 end, fill, 1) as se, aw from w join md using (shot, slice)),
rs as (select shot, slice, n, sqrt(sum(amplitude * cos(radians(phase + n * phi))) ** 2 + sum(amplitude * sin(radians(phase + n * phi))) ** 2) / any_value(aw) as rr,
  degrees(atan2(sum(amplitude * sin(radians(phase + n * phi))), sum(amplitude * cos(radians(phase + n * phi))))) as c
  from ws, range(-3, 4) t(n) group by all),
ch as (select rs.shot, rs.slice, rs.n, any_value(rr) as rr, any_value(c) as c,
  sum((((((phase + rs.n * phi - c + 180) % 360) + 360) % 360 - 180) / se) ** 2) as chi, sum(1 / (se * se)) as iv
  from rs join ws on rs.shot = ws.shot and rs.slice = ws.slice group by rs.shot, rs.slice, rs.n),
po as (select *, exp(-(chi - min(chi) over (partition by shot, slice)) / 2) as e, row_number() over (partition by shot, slice order by rr desc, n) as rn from ch),
pt as (select *, e / sum(e) over (partition by shot, slice) as post from po),
ft as (select shot, slice, n, ((c % 360) + 360) % 360 as intercept_deg, rr as resultant, sqrt(1 / iv) as phase_sigma, post as n_confidence from pt where rn = 1)"""


@query("circular_fit_cursor", f"""with {FIT} select shot, slice, n, {r('intercept_deg')} as intercept_deg, {r('resultant')} as resultant,
  {r('phase_sigma')} as phase_sigma, {r('n_confidence')} as n_confidence from ft""")
def circular_fit_cursor(spark, sf):
    m, _, _ = cursor_mode(spark, sf, 0.004)
    f = modes.circular_fit(m, ["shot", "slice"], N_RANGE).drop("n_probes")
    return out(f.withColumn("n", F.col("n").cast("long")))


@query("mode_track", f"""with {FIT}, st as (select shot, slice, sum(amplitude) as s from ma group by all),
rf as (select shot, slice as ref_slice from (select *, row_number() over (partition by shot order by s desc, slice) as rn from st) where rn = 1),
v as (select ma.shot, slice, channel, amplitude * cos(radians(phase)) as re, amplitude * sin(radians(phase)) as im from ma),
mc as (select v.shot, v.slice, ref_slice, (sum(v.re * b.re + v.im * b.im) ** 2 + sum(v.re * b.im - v.im * b.re) ** 2)
   / (sum(v.re ** 2 + v.im ** 2) * sum(b.re ** 2 + b.im ** 2)) as mac
  from v join rf on rf.shot = v.shot join v b on b.shot = v.shot and b.slice = ref_slice and b.channel = v.channel group by all),
cn as (select shot, n, count(*) as c from ft group by all),
dm as (select shot, n as dominant_n from (select *, row_number() over (partition by shot order by c desc, n) as rn from cn) where rn = 1)
select mc.shot, mc.slice, mc.ref_slice, {r('mac')} as mac, ft.n, dominant_n from mc join ft on ft.shot = mc.shot and ft.slice = mc.slice join dm on dm.shot = mc.shot""")
def mode_track(spark, sf):
    m, _, _ = cursor_mode(spark, sf, 0.004)
    t = cut_lineage(modes.track(m, n_range=N_RANGE))
    d = t.join(modes.dominant_mode(t), "shot")
    return out(d.withColumns({"n": F.col("n").cast("long"), "dominant_n": F.col("dominant_n").cast("long")}))


@query("ridge_track", f"""with {FIT} select ft.shot, ft.slice, bin.k, {r('bin.k * 1562.5 / 1000')} as f_khz, ft.n, {r('a')} as amplitude
from ft join bin on bin.shot = ft.shot and bin.slice = ft.slice and bin.rn = 1
join (select shot, slice, sum(amplitude) as a from ma group by all) s on s.shot = ft.shot and s.slice = ft.slice""")
def ridge_track(spark, sf):
    m, _, _ = cursor_mode(spark, sf, 0.004)
    fit = modes.circular_fit(m, ["shot", "slice"], N_RANGE).select("shot", "slice", F.col("n").cast("long").alias("n"))
    amp = m.groupBy("shot", "slice", "k").agg(F.sum("amplitude").alias("amplitude"))
    return out(amp.join(fit, ["shot", "slice"]).withColumn("f_khz", F.col("k") * 1562.5 / 1000))


@query("active_window", f"""with {LINE_SPECTRA}, p as (select shot, frame, frame * 32 * 1e-5 + 32 * 1e-5 as t_s, sum(re * re + im * im) as e from ls group by shot, frame),
m as (select *, max(e) over (partition by shot) as pk, min(t_s) over (partition by shot) as a0, max(t_s) over (partition by shot) as b0 from p),
s as (select shot, any_value(a0) as a0, any_value(b0) as b0, min(t_s) as a, max(t_s) as b from m where e >= 0.6 * pk group by shot)
select shot, {r('greatest(a0, a - 0.05 * (b - a))', 9)} as t_lo, {r('least(b0, b + 0.05 * (b - a))', 9)} as t_hi from s""")
def active_window(spark, sf):
    s = cut_lineage(line_spectra(spark, sf))
    frames = s.select("shot", "frame").distinct().withColumn("t_s", F.col("frame") * HOP * DT + N_FFT / 2 * DT)
    return out(modes.active_window(s, frames, power_floor_frac=0.6), 9)


# ---- one frequency from raw signals: ranges of 500 samples from every 400th on -------------------------
RAW = f"""{LI},
cu as (select distinct shot, n, i // 400 as cursor, case when (i // 400) % 2 = 0 then 64 else 100 end as np,
  case when (i // 400) % 3 > 0 then 5000.0 + 1000 * ((i // 400) % 30) end as f0 from li),
cs as (select *, least(n, 400 * cursor + 500) - 400 * cursor as m from cu),
c2 as (select shot, cursor, f0, least(np, m) as nf, greatest(1, least(np, m) - least(np, m) // 2) as hop, (m - least(np, m)) // greatest(1, least(np, m) - least(np, m) // 2) as top from cs),
sg as (select c2.*, channel, f, i - 400 * cursor - f * hop as j, value from c2, range(0, 20) t(f), li
  where f <= top and li.shot = c2.shot and i >= 400 * cursor + f * hop and i < 400 * cursor + f * hop + nf),
sv as (select *, (value - avg(value) over (partition by shot, cursor, channel, f)) * case when nf = 1 then 0 else 0.5 - 0.5 * cos(2 * pi() * j / nf) end as v from sg),
rs as (select shot, cursor, nf, f, k, sum(v * cos(2 * pi() * ((k * j) % nf) / nf)) as re, sum(v * sin(2 * pi() * ((k * j) % nf) / nf)) as im
  from sv, range(0, 51) t(k) where channel = 'p1' and f0 is null and k <= nf // 2 group by all),
rp as (select shot, cursor, nf, k, avg((re * re + im * im) * case when k = 0 or 2 * k = nf then 1 else 2 end) as p from rs group by all),
pk as (select shot, cursor, round_even(arg_max(k * 100000 / nf, p), 0) as peak from rp group by all),
fb as (select c2.shot, c2.cursor, nf, coalesce(f0, peak) as f_hz,
  cast(greatest(0, least(nf // 2, ceil(coalesce(f0, peak) * nf / 100000 - 0.5))) as bigint) as k from c2 left join pk using (shot, cursor)),
z as (select sv.shot, sv.cursor, channel, f, fb.nf, f_hz, k, sum(v * cos(2 * pi() * ((k * j) % fb.nf) / fb.nf)) as re,
  sum(case when 2 * k = fb.nf or k = 0 then 0.0 else -v * sin(2 * pi() * ((k * j) % fb.nf) / fb.nf) end) as im
  from sv join fb on fb.shot = sv.shot and fb.cursor = sv.cursor group by all),
x as (select b.shot, b.cursor, b.channel, b.nf, b.f_hz, b.k, avg(b.re * a.re + b.im * a.im) as xr, avg(b.re * a.im - b.im * a.re) as xi,
  avg(a.re * a.re + a.im * a.im) as pa, avg(b.re * b.re + b.im * b.im) as pb, count(*) as n_segments
  from z a join z b on a.shot = b.shot and a.cursor = b.cursor and a.f = b.f and a.channel = 'p1' group by all),
y as (select *, sqrt(xr * xr + xi * xi) as mg, degrees(atan2(xi, xr)) as ph, coalesce((xr * xr + xi * xi) / nullif(pa * pb, 0), 0) as coherence from x)"""


@query("mode_from_signals", f"""with {RAW} select shot, cursor, channel, f_hz, k, n_segments, {r('mg * case when k = 0 or 2 * k = nf then 1 else 2 end / (100000 * 0.375 * nf)', 9)} as amplitude,
  {r('coherence')} as coherence, case when channel = 'p1' or mg < 1e-9 then 0.0 else {r('case when ph < 0 then ph + 360 else ph end', 5)} end as phase,
  case when channel = 'p1' then null else {r('least(180, degrees(sqrt(greatest(0, 1 - g * g)) / (g * sqrt(2 * n_segments))))', 5)} end as phase_error
  from (select *, greatest(1e-3, least(1, sqrt(coherence))) as g from y)""")
def mode_from_signals(spark, sf):
    d = cut_lineage(stacked_lines(spark, sf))
    at = F.floor(F.col("i") / 400)
    cursors = d.where(F.col("channel") == "p1").select("shot", at.alias("cursor")).distinct().withColumns({
        "t_lo": (400 * F.col("cursor") - 0.5) * DT, "t_hi": (400 * F.col("cursor") + 499.5) * DT,
        "nperseg": F.when(F.col("cursor") % 2 == 0, 64).otherwise(100), "f_hz": F.when(F.col("cursor") % 3 > 0, 5000.0 + 1000 * (F.col("cursor") % 30))})
    ref = d.select("shot").distinct().withColumn("ref", F.lit("p1"))
    m = modes.mode_from_signals(d, line_angles(spark, sf), cursors, ref, float(round(1 / DT)))
    none = (F.col("channel") == "p1") | (F.col("amplitude") < 1e-15)
    m = m.withColumns({"phase": F.when(none, 0.0).otherwise(F.col("phase")), "phase_error": F.when(~F.isnan("phase_error"), F.col("phase_error")), "k": F.col("k").cast("long")})
    return out(m.select("shot", "cursor", "channel", "f_hz", "k", "n_segments", "amplitude", "coherence", "phase", "phase_error"), amplitude=9, phase=5, phase_error=5)


# ---- ring snapshots --------------------------------------------------------------------------------
RING_FIT = f"""{R32},
ph as (select vec_id, p, phi, sqrt(re * re + im * im) as a, degrees(atan2(im, re)) as phase from r32),
rs as (select vec_id, n, sqrt(sum(a * cos(radians(phase + n * phi))) ** 2 + sum(a * sin(radians(phase + n * phi))) ** 2) / sum(a) as rr,
  degrees(atan2(sum(a * sin(radians(phase + n * phi))), sum(a * cos(radians(phase + n * phi))))) as c from ph, range(-6, 7) t(n) group by all),
bs as (select *, row_number() over (partition by vec_id order by rr desc, n) as rn from rs)"""


def ring_mode(spark, sf):
    d = ring32(spark, sf)
    return d.select("vec_id", F.col("p").alias("channel"), "phi", F.hypot("re", "im").alias("amplitude"), F.degrees(F.atan2("im", "re")).alias("phase"))


@query("circular_fit", f"""with {RING_FIT} select vec_id, n, {r('((c % 360) + 360) % 360')} as intercept_deg, {r('rr')} as resultant from bs where rn = 1""")
def circular_fit(spark, sf):
    f = modes.circular_fit(ring_mode(spark, sf), ["vec_id"])
    return out(f.select("vec_id", F.col("n").cast("long").alias("n"), "intercept_deg", "resultant"))


@query("circular_posterior", f"""with {RING_FIT},
ch as (select rs.vec_id, rs.n, sum((((((phase + rs.n * phi - c + 180) % 360) + 360) % 360 - 180) / 60) ** 2) as chi from rs join ph using (vec_id) group by all),
po as (select *, exp(-(chi - min(chi) over (partition by vec_id)) / 2) as e from ch),
pt as (select vec_id, n, e / sum(e) over (partition by vec_id) as post from po)
select pt.vec_id, pt.n, {r('post')} as n_confidence, {r('60 / sqrt(32)')} as phase_sigma from pt join bs on bs.vec_id = pt.vec_id and bs.n = pt.n and rn = 1""")
def circular_posterior(spark, sf):
    f = modes.circular_fit(ring_mode(spark, sf).withColumn("phase_error", F.lit(60.0)), ["vec_id"])
    return out(f.select("vec_id", F.col("n").cast("long").alias("n"), "n_confidence", "phase_sigma"))


@query("mac_templates", f"""with {R32},
m as (select vec_id, n, (sum(re * cos(n * radians(phi)) - im * sin(n * radians(phi))) ** 2 + sum(-re * sin(n * radians(phi)) - im * cos(n * radians(phi))) ** 2)
  / (sum(re * re + im * im) * 32) as mac from r32, range(-6, 7) t(n) group by all),
b as (select *, row_number() over (partition by vec_id order by mac desc, n) as rn from m)
select m.vec_id, m.n, {r('m.mac')} as mac, b.n as best_n from m join b on b.vec_id = m.vec_id and b.rn = 1""")
def mac_templates(spark, sf):
    d = modes.mac_templates(ring32(spark, sf), ["vec_id"])
    d = d.select("vec_id", F.col("best_n").cast("long").alias("best_n"), F.inline("spectrum"))
    return out(d.withColumn("n", F.col("n").cast("long")))


@query("mac_matrix", f"""with {R32}, rf as (select label, min(vec_id) as ref from embeddings group by label),
b as (select r32.label, p, re as wr, im as wi from r32 join rf on rf.ref = r32.vec_id)
select a.vec_id, b.label as ref_label, {r('(sum(re * wr + im * wi) ** 2 + sum(re * wi - im * wr) ** 2) / (sum(re * re + im * im) * sum(wr * wr + wi * wi))')} as mac
from r32 a join b on a.p = b.p group by all""")
def mac_matrix(spark, sf):
    """Each vector against one reference shape per label (ten of them)."""
    d = ring32(spark, sf)
    first = d.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    ref = d.join(first, ["label", "vec_id"]).select("p", F.col("label").alias("ref_label"), F.col("re").alias("w_re"), F.col("im").alias("w_im"))
    return out(modes.mac(d.drop("label"), ref, ["p"], ["vec_id", "ref_label"]))


@query("wrapped_ramp", f"""with {RING_FIT}, f as (select vec_id, n, ((c % 360) + 360) % 360 as c from bs where rn = 1),
g as (select vec_id, o, (((c - n * o) % 360) + 360) % 360 as y from f, range(0, 361) t(o)),
h as (select *, o > 0 and abs(y - lag(y) over (partition by vec_id order by o)) > 180 as jump from g)
select vec_id, 2 * o + 1 as ord, round(o, 1)::double as x, {r('y', 1)} as y from h union all
select vec_id, 2 * o, null, null from h where jump""")
def wrapped_ramp(spark, sf):
    f = modes.circular_fit(ring_mode(spark, sf), ["vec_id"])
    return out(modes.wrapped_ramp(f, ["vec_id"]), 1)


# ---- Gaussian-process shapes -------------------------------------------------------------------------
@query("gp_mode_shape")
def gp_mode_shape(spark, sf):
    """Smooth shape of every ring snapshot."""
    d = ring32(spark, sf).withColumn("noise", F.lit(0.05))
    return out(shape.gp_mode_shape(d, ["vec_id"]))


@query("mode_pattern")
def mode_pattern(spark, sf):
    """Field pattern of every vector: its first half's shape along phi times its second half's along theta."""
    d = ring32(spark, sf).withColumn("noise", F.lit(0.05))
    half = F.floor(F.col("p") / 16)
    d = d.withColumns({"half": half, "phi": (F.col("p") % 16) * 22.5, "p": F.col("p") % 16})
    halves = [d.where(F.col("half") == j).drop("half") for j in (0, 1)]
    m = shape.gp_pattern(*halves, ["vec_id"], maps=table(spark, sf, "embeddings").count())
    return m.select("vec_id", *[(X.round_to(c, 6) + F.lit(0.0)).alias(c) for c in ("phi", "theta", "z")])


@query("shape_noise", f"""with {R32}, a as (select vec_id, p, sqrt(re * re + im * im) as amp from r32),
s as (select vec_id, p, case when p = 0 then null else sqrt((0.1 * amp) ** 2 + (amp * radians(5.0 + p)) ** 2) end as s from a),
f as (select vec_id, median(s) as m from s where s > 0 group by vec_id)
select vec_id, p, {r('coalesce(s, m)', 9)} as noise from s join f using (vec_id)""")
def shape_noise(spark, sf):
    d = ring32(spark, sf).withColumn("amplitude", F.hypot("re", "im"))
    nan = F.lit(float("nan"))
    d = d.withColumn("phase_error", F.when(F.col("p") == 0, nan).otherwise(5.0 + F.col("p"))).withColumn(
        "amplitude_error", F.when(F.col("p") == 0, nan).otherwise(0.1 * F.col("amplitude")))
    return out(shape.shape_noise(d, ["vec_id"]).select("vec_id", F.col("p").cast("long").alias("p"), "noise"), 9)
