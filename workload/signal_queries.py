"""Alignment, conditioning, calibration and ingest rules on the recordings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.operators import align, blocks, condition, resample, summaries
from ringwave.sources import lake
from workload.inputs import DT, EV, LI, event_samples, line_angles, line_samples, stacked_lines, table
from workload.registry import out, query, r

CH = "shot, channel"


# ---- windows, decimation, stacking ------------------------------------------------------------
@query("stack_array", f"with {LI} select shot, channel, i, {r('value')} as value from li")
def stack_array(spark, sf):
    return out(stacked_lines(spark, sf).select("shot", "channel", "i", "value"))


@query("trim_decimate", f"""with {LI}, t as (select *, i - min(i) over (partition by {CH}) as j from li0 where i * 1e-5 between 0.0005 and 0.02)
select shot, channel, j // 7 as i, {r('i * 1e-5', 9)} as t_s, {r('value')} as value from t where j % 7 = 0""")
def trim_decimate(spark, sf):
    d = align.reindex(align.trim(line_samples(spark, sf), 0.0005, 0.02))
    return out(align.decimate(d, 7), 9, value=6)


@query("decimation_policy", """select l_suppkey as shot, l_linenumber as line, case when min(l_tax) < 0.01 and not bool_or(l_returnflag = 'R' and l_quantity > 49)
  then 5 else 1 end as step from lineitem group by all""")
def decimation_policy(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("shot"), F.col("l_linenumber").alias("line")).agg(
        F.min("l_tax").alias("t"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("raw"))
    return d.select("shot", "line", align.decimation_step(5, F.col("t") < 0.01, F.col("raw")).alias("step"))


@query("cursor_window", f"""with {EV}, n as (select shot, channel, count(*) as n, count(*) filter (t_s between 0.061 and 0.063) as hits from ev group by all)
select ev.shot, ev.channel, i, value from ev join n on n.shot = ev.shot and n.channel = ev.channel
where case when hits < 2 then i >= greatest(0, n // 2 - 5) and i < least(n, n // 2 + 5) else t_s between 0.061 and 0.063 end""")
def cursor_window(spark, sf):
    d = event_samples(spark, sf)
    return align.cursor_window(d, F.lit(0.061), F.lit(0.063), 2, 5, ["shot", "channel"]).select("shot", "channel", "i", "value")


@query("display_columns", f"""with {LI}, b as (select shot, max(i) as hi from li group by shot),
ix as (select distinct shot, case when j = least(159, hi) then hi else cast(floor(j * (hi / least(159, hi))) as bigint) end as i from b, range(0, 160) t(j) where j <= hi)
select shot, channel, i, {r('value')} as value from li join ix using (shot, i)""")
def display_columns(spark, sf):
    return out(summaries.display_columns(stacked_lines(spark, sf), 160, idx="i").select("shot", "channel", "i", "value"))


# ---- clocks and angles -----------------------------------------------------------------------------
@query("align_interp", f"""with {EV}, per as (select {CH}, count(*) as n, min(t_real) as a, max(t_real) as b from ev group by all),
rf as (select shot, arg_min(channel, (-n, channel)) as ref, max(a) as lo, min(b) as hi from per group by shot),
grid as (select ev.shot, ev.t_real as t from ev join rf on rf.shot = ev.shot and ev.channel = ref where t_real between lo and hi),
ask as (select g.shot, p.channel, g.t from grid g join per p using (shot)),
seg as (select {CH}, t_real as t0, value as v0, lead(t_real) over w as t1, lead(value) over w as v1 from ev window w as (partition by {CH} order by t_real))
select k.shot, k.channel, {r('k.t')} as t_real, {r('case when k.t = t0 or t1 is null then v0 else (v1 - v0) / (t1 - t0) * (k.t - t0) + v0 end')} as value
from ask k join seg s on s.shot = k.shot and s.channel = k.channel and k.t >= t0 and (t1 is null or k.t < t1)""")
def align_interp(spark, sf):
    return out(align.on_common_clock(event_samples(spark, sf), 86400.0, "t_real"))


@query("context_traces", f"""with {EV}, b as (select shot, min(channel) as base from ev where channel in ('c2', 'c5') group by shot),
grid as (select ev.shot, ev.t_real as t from ev join b on b.shot = ev.shot and ev.channel = base),
seg as (select {CH}, t_real as t0, value as v0, lead(t_real) over w as t1, lead(value) over w as v1,
   row_number() over w as rn from ev where channel in ('c2', 'c5') window w as (partition by {CH} order by t_real)),
y as (select g.shot, g.t, s.channel, case when g.t < t0 or g.t = t0 or t1 is null then v0 else (v1 - v0) / (t1 - t0) * (g.t - t0) + v0 end as v
  from grid g join seg s on s.shot = g.shot and ((g.t >= t0 and (t1 is null or g.t < t1)) or (rn = 1 and g.t < t0)))
select shot, {r('t')} as t_real, {r("max(v) filter (channel = 'c2')")} as c2, {r("max(v) filter (channel = 'c5')")} as c5 from y group by shot, t""")
def context_traces(spark, sf):
    """Two context channels on the clock of the first one, end values held."""
    return out(align.paired_traces(event_samples(spark, sf), ["c2", "c5"], "c2", 86400.0, "t_real"))


@query("nearest_sample", f"""with {EV}, k as (select *, row_number() over (partition by {CH} order by abs(t_real - 1000000), t_real) as rn from ev)
select shot, channel, {r('t_real')} as t_real, value, i from k where rn = 1""")
def nearest_sample(spark, sf):
    d = event_samples(spark, sf)
    at = d.select("shot", "channel").distinct().withColumn("t0", F.lit(1e6))
    return out(align.nearest(d, at, ["shot", "channel"], "t_real", "t0", ["value", "i"]).drop("t0"))


@query("angle_grid", f"""with {LI}, s as (select distinct shot, channel, phi from li),
seg as (select shot, channel as c0, phi as a0, coalesce(lead(phi) over w, 360 + min(phi) over (partition by shot)) as a1,
  coalesce(lead(channel) over w, first_value(channel) over w) as c1 from s window w as (partition by shot order by phi)),
g as (select shot, 30 * q as angle, c0, c1, (30 * q - a0) / (a1 - a0) as f from seg, range(0, 13) t(q)
  where (30 * q >= a0 and 30 * q < a1) or (q = 12 and a0 = 0)),
gg as (select shot, angle, case when angle = 360 then 'p1' else c0 end as c0, case when angle = 360 then 'p1' else c1 end as c1, case when angle = 360 then 0 else f end as f from g)
select gg.shot, a.i, angle::double as angle, {r('a.value * (1 - f) + b.value * f', 8)} as z from gg
join li a on a.shot = gg.shot and a.channel = c0 join li b on b.shot = gg.shot and b.channel = c1 and b.i = a.i""")
def angle_grid(spark, sf):
    d = stacked_lines(spark, sf)
    sensors = d.select("shot", "channel").distinct().join(line_angles(spark, sf), "channel")
    return out(align.on_angle_grid(d, align.angle_weights(sensors, 13), along=("i",)), 8)


# ---- corrections -------------------------------------------------------------------------------------
@query("swap_channels", f"""with {LI}, b as (select shot, count(distinct channel) = 2 as paired from li0 where channel in ('p2', 'p6') group by shot)
select li0.shot, case when paired and shot > 5 then (case channel when 'p2' then 'p6' when 'p6' then 'p2' else channel end) else channel end as channel, i, {r('value')} as value
from li0 join b using (shot)""")
def swap_channels(spark, sf):
    return out(align.swap_pair(line_samples(spark, sf), "p2", "p6", 5).select("shot", "channel", "i", "value"))


@query("dc_compensation", f"""with {LI}, cp as (select shot, channel, coil, (cast(substr(channel, 2) as int) + cast(substr(coil, 2) as int)) / 100 as k
  from (select distinct shot, channel from li), (select unnest(['p6', 'p7']) as coil) where not (shot = 14 and channel = 'p3')),
v as (select cp.shot, cp.channel, i, sum(k * value) as vac from cp join li on li.shot = cp.shot and li.channel = cp.coil group by all)
select li.shot, li.channel, li.i, {r('case when li.shot = 14 then value else value - vac end', 8)} as value from li left join v on v.shot = li.shot and v.channel = li.channel and v.i = li.i""")
def dc_compensation(spark, sf):
    """Two channels act as coils; one recording lacks a coupling record and stays as it is."""
    d = stacked_lines(spark, sf).select("shot", "channel", "i", "value")
    num = lambda c: F.substring(c, 2, 1).cast("int")
    names = d.select("shot", "channel").distinct().withColumn("coil", F.explode(F.array(F.lit("p6"), F.lit("p7"))))
    coupling = names.where(~((F.col("shot") == 14) & (F.col("channel") == "p3"))).withColumn("dc_coupling", (num("channel") + num("coil")) / 100)
    coils = d.where(F.col("channel").isin("p6", "p7")).withColumnRenamed("channel", "coil")
    return out(align.compensate(d, coils, coupling), 8)


@query("calibrate_units", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  round(l_extendedprice * coalesce(case when l_returnflag <> 'A' then 1 + l_tax end, 1) / coalesce(nullif(case when l_linestatus = 'F' then l_discount end, 0), 1), 6) + 0.0 as physical,
  round(l_quantity * case when l_returnflag = 'N' then 1000 else 1 end, 4) + 0.0 as t_ms, round(l_tax * 10000, 4) + 0.0 as gauss from lineitem""")
def calibrate_units(spark, sf):
    d = table(spark, sf, "lineitem")
    gain = F.when(F.col("l_returnflag") != "A", 1 + F.col("l_tax"))
    na = F.when(F.col("l_linestatus") == "F", F.col("l_discount"))
    unit = F.when(F.col("l_returnflag") == "N", "s").otherwise("ms")
    return out(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", X.calibrated("l_extendedprice", gain, na).alias("physical"),
                        X.to_ms("l_quantity", unit).alias("t_ms"), (F.col("l_tax") * X.TESLA_TO_GAUSS).alias("gauss")), 4, physical=6)


# ---- integration and filters ----------------------------------------------------------------------------
@query("integrate_trapezoid", f"""with {EV}, m as (select *, value - avg(value) over (partition by {CH}) as v from ev),
d as (select *, (v + lag(v) over w) / 2 * (t_real - lag(t_real) over w) as inc from m window w as (partition by {CH} order by i))
select shot, channel, i, {r('sum(coalesce(inc, 0)) over (partition by shot, channel order by i rows unbounded preceding)', 2)} as value from d""")
def integrate_trapezoid(spark, sf):
    return out(condition.integrate(event_samples(spark, sf), t="t_real").select("shot", "channel", "i", "value"), 2)


@query("integrate_highpass", f"""with {LI}, n as (select shot, channel, max(i) + 1 as c from li0 group by all),
k as (select a.shot, a.channel, a.i, any_value(a.value) - avg(b.value) as v from li0 a join n on n.shot = a.shot and n.channel = a.channel, range(-10, 11) t(o)
  join li0 b on b.shot = a.shot and b.channel = a.channel and b.i = case when a.i + o < 0 then -1 - (a.i + o) when a.i + o >= c then 2 * c - 1 - (a.i + o) else a.i + o end group by a.shot, a.channel, a.i),
d as (select *, (v + lag(v) over w) / 2 * 1e-5 as inc from k window w as (partition by {CH} order by i))
select shot, channel, i, {r('1e3 * sum(coalesce(inc, 0)) over (partition by shot, channel order by i rows unbounded preceding)', 9)} as value from d""")
def integrate_highpass(spark, sf):
    """Integral after removing a 21-sample running mean."""
    d = condition.integrate(line_samples(spark, sf).drop("t_real"), highpass_points=21)
    return out(d.select("shot", "channel", "i", (F.col("value") * 1e3).alias("value")), 9)


def _causal_sql(src: str, sigma: str, radius: int, name: str, extra: str = "") -> str:
    return f"""{name}w as (select o, exp(-0.5 * (o / {sigma}) ** 2) / (select sum(exp(-0.5 * (q / {sigma}) ** 2)) from range(0, {radius + 1}) t(q)) as w from range(0, {radius + 1}) t(o)),
{name} as (select a.shot, a.channel, a.i, sum(w * b.value) as value from {src} a, {name}w join {src} b
  on b.shot = a.shot and b.channel = a.channel and b.i = greatest(0, a.i - o) group by all)"""


@query("causal_lowpass", f"with {LI}, {_causal_sql('li0', '6.25', 25, 'lp')} select shot, channel, i, {r('value')} as value from lp")
def causal_lowpass(spark, sf):
    return out(condition.causal_gaussian(line_samples(spark, sf), 6.25).select("shot", "channel", "i", "value"))


@query("causal_bandpass", f"""with {LI}, {_causal_sql('li0', '2.5', 10, 'fa')}, {_causal_sql('fa', '12.5', 50, 'sl')}
select fa.shot, fa.channel, fa.i, {r('fa.value - sl.value')} as value from fa join sl on sl.shot = fa.shot and sl.channel = fa.channel and sl.i = fa.i""")
def causal_bandpass(spark, sf):
    fast = condition.causal_gaussian(line_samples(spark, sf), 2.5)
    d = condition.causal_gaussian(fast, 12.5, out="slow")
    return out(d.select("shot", "channel", "i", (F.col("value") - F.col("slow")).alias("value")))


@query("band_filter", f"""with {LI}, st as (select shot, n, cast(least(greatest(1, floor(50000 / 4000)), ceil(n / 300)) as bigint) as step from ln),
th as (select li.shot, channel, i // step as i, value, 0.25 / (1e-5 * step * 4000) as s1, 0.25 / (1e-5 * step * 1000) as s0 from li join st using (shot) where i % step = 0),
w1 as (select shot, o, exp(-0.5 * (o / s1) ** 2) as w from (select distinct shot, s1 from th), range(0, 400) t(o) where o <= case when s1 > 0 and floor(4 * s1 + 0.5) >= 1 then floor(4 * s1 + 0.5) else 0 end),
n1 as (select shot, o, w / sum(w) over (partition by shot) as w from w1),
f1 as (select a.shot, a.channel, a.i, any_value(a.s0) as s0, sum(w * b.value) as value from th a join n1 on n1.shot = a.shot join th b on b.shot = a.shot and b.channel = a.channel and b.i = greatest(0, a.i - o) group by a.shot, a.channel, a.i),
w0 as (select shot, o, exp(-0.5 * (o / s0) ** 2) as w from (select distinct shot, s0 from th), range(0, 400) t(o) where o <= floor(4 * s0 + 0.5)),
n0 as (select shot, o, w / sum(w) over (partition by shot) as w from w0),
f0 as (select a.shot, a.channel, a.i, any_value(a.value) - sum(w * b.value) as value from f1 a join n0 on n0.shot = a.shot join f1 b on b.shot = a.shot and b.channel = a.channel and b.i = greatest(0, a.i - o) group by a.shot, a.channel, a.i)
select shot, channel, i, {r('value')} as value from f0""")
def band_filter(spark, sf):
    """Automatic thinning, then a causal band-pass whose widths depend on each recording's clock."""
    d = stacked_lines(spark, sf)
    clock = d.groupBy("shot").agg((F.max("i") + 1).alias("n")).withColumn("dt", F.lit(DT))
    return out(condition.band_filter(d, clock, 1000.0, 4000.0).select("shot", "channel", "i", "value"))


# ---- detrending ---------------------------------------------------------------------------------------------
def _detrend(kind, trend, digits=9):
    @query(f"detrend_{kind}", f"""with {LI}, s as (select *, i * 1e-5 as t from li0), b as ({trend})
    select s.shot, s.channel, i, {r('value - (a * s.t + c)', digits)} as value from s join b on b.shot = s.shot and b.channel = s.channel""")
    def run(spark, sf):
        return out(condition.detrend(line_samples(spark, sf), kind, [(0.0002, 0.0021), (0.01, 0.02)]).select("shot", "channel", "i", "value"), digits)

    return run


BAND = "(t between 0.0002 and 0.0021 or t between 0.01 and 0.02)"
_detrend("baseline", f"select {CH}, 0 as a, avg(value) as c from s where {BAND} group by all")
_detrend("linear", f"select {CH}, regr_slope(value, t) as a, regr_intercept(value, t) as c from s where {BAND} group by all", 6)
_detrend("endpoints", f"""select {CH}, (v1 - v0) / (t1 - t0) as a, v0 - (v1 - v0) / (t1 - t0) * t0 as c from
  (select {CH}, arg_min(value, t) as v0, arg_max(value, t) as v1, min(t) as t0, max(t) as t1 from s where t between 0.0002 and 0.02 group by all)""")


@query("shifted_raw", f"""with {LI}, {_causal_sql('li0', '6.25', 25, 'lp')},
f as (select li0.shot, li0.channel, li0.i, li0.value as raw, lp.value as prep from li0 join lp using (shot, channel, i)),
s as (select {CH}, arg_min(raw, i) as r0, arg_min(prep, i) as p0 from f group by all)
select f.shot, f.channel, i, {r('raw - r0 + p0')} as raw, {r('prep')} as prepared from f join s on s.shot = f.shot and s.channel = f.channel""")
def shifted_raw(spark, sf):
    """Raw signal moved to the start value of the prepared one."""
    d = condition.causal_gaussian(line_samples(spark, sf), 6.25, out="prepared")
    s = d.groupBy("shot", "channel").agg(F.min_by("value", "i").alias("r0"), F.min_by("prepared", "i").alias("p0"))
    return out(d.join(s, ["shot", "channel"]).select("shot", "channel", "i", (F.col("value") - F.col("r0") + F.col("p0")).alias("raw"), "prepared"))


# ---- resampling ---------------------------------------------------------------------------------------------
RESAMPLED = f"""with {EV}, c as (select {CH}, count(*) as n, cast(floor((max(t_s) - min(t_s)) * 500) as bigint) as m from ev group by all),
x as (select ev.shot, ev.channel, n, m, k, sum(value * cos(2 * pi() * ((k * i) % n) / n)) as re, -sum(value * sin(2 * pi() * ((k * i) % n) / n)) as im
  from ev join c on c.shot = ev.shot and c.channel = ev.channel, range(0, 100) t(k) where k <= least(n, m) // 2 group by all),
y as (select x.shot, x.channel, q as i, any_value(n) as n, any_value(m) as m, sum(case when k = 0 then re when m % 2 = 0 and k = m // 2 then 2 * re * cos(pi() * q)
   else 2 * (re * cos(2 * pi() * ((k * q) % m) / m) - im * sin(2 * pi() * ((k * q) % m) / m)) end) / any_value(n) as value
  from x, range(0, 100) t(q) where q < m group by x.shot, x.channel, q)
select shot, channel, i, {r('i * 1e-3 * n / m', 9)} as t_s, {r('value')} as value from y"""


@query("resample_fft_long", RESAMPLED)
def resample_fft_long(spark, sf):
    """The same by the split chirp transform of long records, for all records of over 16 samples."""
    return out(resample.resample(event_samples(spark, sf), 500.0, direct_limit=16), 9, value=6)


@query("resample_fft", RESAMPLED)
def resample_fft(spark, sf):
    """Fourier resampling to half the rate."""
    return out(resample.resample(event_samples(spark, sf), 500.0), 9, value=6)


@query("resample_blocks", f"with {EV} select shot, channel, cast(floor(t_real / 43200) as bigint) as i, {r('avg(value)')} as value from ev group by all")
def resample_blocks(spark, sf):
    return out(resample.block_average(event_samples(spark, sf), 1 / 43200.0, t="t_real").select("shot", "channel", "i", "value"))


# ---- noise removal ------------------------------------------------------------------------------------------
@query("gram_matrix", f"""with {LI} select a.shot, a.channel as c1, b.channel as c2, {r('sum(a.value * b.value)', 3)} as g
from li a join li b on a.shot = b.shot and a.i = b.i and a.channel <= b.channel group by all""")
def gram_matrix(spark, sf):
    return out(condition.gram(stacked_lines(spark, sf)), 3)


@query("svd_condition")
def svd_condition(spark, sf):
    clean, _ = condition.svd_condition(stacked_lines(spark, sf), 0.9)
    return out(clean.select("shot", "channel", "i", "value"))


@query("svd_energy")
def svd_energy(spark, sf):
    d = stacked_lines(spark, sf)
    b = condition.singular_basis(condition.gram(d), d.groupBy("shot").agg((F.max("i") + 1).alias("n_time")), 0.9)
    return out(b.select("shot", "rank", F.posexplode(F.arrays_zip("svals", "energy_fraction")).alias("idx", "v")).select("shot", "rank", "idx", "v.*"))


# ---- ingest rules ---------------------------------------------------------------------------------------------
@query("degenerate_channels", """select user_id // 8 as shot, 'c' || (user_id % 8) || '-' || event_type as channel, count(*) filter (value <= 60) as n,
  case when bool_or(value > 60) then 'missing' when count(*) filter (value <= 60) < 8 then 'missing' else 'fetched' end as status,
  case when bool_or(value > 60) then 'no usable time axis' when count(*) filter (value <= 60) < 8 then 'degenerate (n=' || count(*) filter (value <= 60) || ')' end as error
from events group by all""")
def degenerate_channels(spark, sf):
    """Channels per user and event type; a large value stands for a sample without a time."""
    d = table(spark, sf, "events").select(
        F.floor(F.col("user_id") / 8).alias("shot"), F.concat(F.lit("c"), F.col("user_id") % 8, F.lit("-"), "event_type").alias("channel"),
        F.col("event_id").alias("i"), "value", F.when(F.col("value") <= 60, F.unix_micros(F.col("ts").cast("timestamp")) / 1e3).alias("t_ms"))
    return lake.channel_status(d, min_points=8, increasing=True).select("shot", "channel", "n", "status", "error")


@query("incremental_missing", """with rq as (select distinct l_suppkey as shot, l_partkey as channel, l_linenumber % 3 as decimate, case when l_linestatus = 'F' then l_linenumber * 1.0e0 end as tmin from lineitem),
att as (select distinct l_suppkey as shot, l_partkey as channel, l_linenumber % 3 as decimate, case when l_linestatus = 'F' then l_linenumber * 1.0e0 end as tmin from lineitem where l_returnflag = 'R')
select shot, channel, decimate, tmin from rq where not exists (select 1 from att where att.shot = rq.shot and att.channel = rq.channel and att.decimate = rq.decimate and att.tmin is not distinct from rq.tmin)""")
def incremental_missing(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("shot"), F.col("l_partkey").alias("channel"), (F.col("l_linenumber") % 3).alias("decimate"),
        F.when(F.col("l_linestatus") == "F", F.col("l_linenumber") * 1.0).alias("tmin"), F.lit(None).cast("double").alias("tmax"), "l_returnflag")
    cols = ["shot", "channel", "tmin", "tmax", "decimate"]
    asked, have = d.select(*cols).distinct(), d.where(F.col("l_returnflag") == "R").select(*cols).distinct()
    return lake.incremental(asked, have).select("shot", "channel", "decimate", "tmin")


@query("merged_status", """select l_suppkey as shot, l_partkey as channel, case when bool_or(l_tax < 0.04) then 'fetched' else 'missing' end as status from lineitem group by all""")
def merged_status(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shot"), F.col("l_partkey").alias("channel"),
                                            F.when(F.col("l_tax") < 0.04, "fetched").otherwise("missing").alias("status"), "l_returnflag")
    return lake.merge_status(d.where(F.col("l_returnflag") == "R").drop("l_returnflag"), d.where(F.col("l_returnflag") != "R").drop("l_returnflag"))


@query("time_base_dedup", """with h as (select user_id, list(event_type order by ts, event_id) as axis from events group by user_id)
select user_id // 8 as shot, count(*) as channels, count(distinct axis) as bases from h group by all""")
def time_base_dedup(spark, sf):
    """Channels sharing a time vector, told by the content of the whole vector: here all event types of a user."""
    d = event_samples(spark, sf).select("shot", "channel", "i", F.col("event_type").alias("t_ms"))
    return lake.time_base_hash(d).groupBy("shot").agg(F.count(F.lit(1)).alias("channels"), F.count_distinct("tb_id").alias("bases"))


@query("shot_window", """with w as (select user_id // 8 as shot, min(event_id) filter (event_type = 'click') as tmin, max(event_id) filter (event_type = 'error') as tmax from events group by all),
f as (select user_id // 8 as shot, user_id % 8 as c, min(epoch_us(ts)) / 1e3 as a, max(epoch_us(ts)) / 1e3 as b from events group by all),
s as (select shot, arg_min(a, c) as a, arg_min(b, c) as b from f group by shot)
select w.shot, round(case when tmax > tmin and w.shot % 2 = 0 then tmin else a end, 3) + 0.0 as t_lo, round(case when tmax > tmin and w.shot % 2 = 0 then tmax else b end, 3) + 0.0 as t_hi from w join s using (shot)""")
def shot_window(spark, sf):
    """Half of the recordings keep a stored window, the others (whole-record marker) take their span."""
    e = table(spark, sf, "events").withColumn("shot", F.floor(F.col("user_id") / 8))
    w = e.groupBy("shot").agg(F.min(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("lo"), F.max(F.when(F.col("event_type") == "error", F.col("event_id"))).alias("hi"))
    mark = F.when(F.col("shot") % 2 == 0, F.col("lo").cast("string")).otherwise("*")
    shots = w.select("shot", X.known_window_bound(mark).alias("tmin"), X.known_window_bound(F.when(F.col("shot") % 2 == 0, F.col("hi").cast("string")).otherwise("*")).alias("tmax"))
    samples = e.select("shot", F.concat(F.lit("c"), F.col("user_id") % 8).alias("channel"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e3).alias("t_ms"))
    return out(lake.shot_window(shots, samples).select("shot", "t_lo", "t_hi"), 3)


@query("exact_percentiles", f"""with {LI} select shot, {r('quantile_cont(value, 0.37)')} as p37, {r('quantile_cont(value, 0.99)')} as p99 from li0 group by shot""")
def exact_percentiles(spark, sf):
    d = line_samples(spark, sf)
    return out(blocks.exact_percentiles(d, ["shot"], "value", {"p37": 0.37, "p99": 0.99}))
