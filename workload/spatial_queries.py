"""Bases, spatial fits, field maps and condition numbers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.operators import spatial, summaries
from ringwave.session import cut_lineage
from workload.inputs import R64, ring_samples, ring_sensors, table
from workload.registry import out, query, r

MODES = 3


def ring_fit(spark, sf, basis="sinusoidal-point"):
    sensors = spatial.basis_rows(spatial.fill_sigma(ring_sensors(spark, sf)), ns=(1, 2, 3), basis=basis)
    inv = cut_lineage(spatial.invert_design(sensors))  # read for the coefficients and for what is told of the fit
    samples = ring_samples(spark, sf)
    return samples, inv, spatial.fit_meta(inv), spatial.fit_coefficients(samples, inv, MODES)


def ring_rows(spark, sf, basis="sinusoidal-point"):
    _, _, meta, coef = ring_fit(spark, sf, basis)
    return spatial.mode_rows(coef, meta, MODES)


COEF = f"""{R64},
cf as (select vec_id as i, label as shot, n, sum(v * cos(n * radians(phi))) / 32 as re, sum(v * sin(n * radians(phi))) / 32 as im from r64, range(1, 4) t(n) group by all)"""


@query("spatial_fit", f"with {COEF} select shot, i, n, {r('re')} as re, {r('im')} as im, {r('sqrt(1 / 32)')} as sigma_re, {r('sqrt(1 / 32)')} as sigma_im from cf")
def spatial_fit(spark, sf):
    return out(ring_rows(spark, sf).select("shot", "i", F.col("n").cast("int").alias("n"), "re", "im", "sigma_re", "sigma_im"))


@query("spatial_fit_integral", f"""with {COEF} select shot, i, n, {r('re / (sin(n * radians(0.5)) / (n * radians(0.5)))')} as re, {r('im / (sin(n * radians(0.5)) / (n * radians(0.5)))')} as im from cf""")
def spatial_fit_integral(spark, sf):
    return out(ring_rows(spark, sf, "sinusoidal-integral").select("shot", "i", F.col("n").cast("int").alias("n"), "re", "im"))


@query("fit_chi_square", f"""with {COEF}, ft as (select i, p, any_value(v) as v, sum(re * cos(n * radians(phi)) + im * sin(n * radians(phi))) as fit from r64 join cf on cf.i = r64.vec_id group by i, p),
c as (select i, sum((v - fit) ** 2) as chi from ft group by i)
select label as shot, i, {r('chi')} as chi_sq, {r('chi / 58')} as red_chi_sq from c join embeddings e on e.vec_id = c.i""")
def fit_chi_square(spark, sf):
    samples, inv, meta, coef = ring_fit(spark, sf)
    return out(spatial.chi_square(coef, inv, MODES).drop("t_s"))


@query("fit_residuals", f"""with {COEF} select label as shot, vec_id as i, lpad(p::varchar, 2, '0') as channel, {r('any_value(v)')} as value,
  {r('sum(re * cos(n * radians(phi)) + im * sin(n * radians(phi)))')} as fit, {r('any_value(v) - sum(re * cos(n * radians(phi)) + im * sin(n * radians(phi)))')} as residual
from r64 join cf on cf.i = r64.vec_id group by label, vec_id, p""")
def fit_residuals(spark, sf):
    samples, inv, _, coef = ring_fit(spark, sf)
    return out(spatial.fitted_signal(samples, coef, inv, MODES).select("shot", "i", "channel", "value", "fit", "residual"))


@query("worst_channels", f"""with {COEF}, rs as (select label as shot, vec_id as i, lpad(p::varchar, 2, '0') as channel, any_value(v) - sum(re * cos(n * radians(phi)) + im * sin(n * radians(phi))) as q
  from r64 join cf on cf.i = r64.vec_id group by label, vec_id, p),
s as (select shot, channel, max(q) - min(q) as swing from rs group by all), k as (select *, row_number() over (partition by shot order by swing desc, channel) as rank from s)
select shot, channel, {r('swing')} as swing, rank from k where rank <= 6""")
def worst_channels(spark, sf):
    samples, inv, _, coef = ring_fit(spark, sf)
    return out(summaries.top_by_swing(spatial.fitted_signal(samples, coef, inv, MODES), ["shot"], "channel", "residual"))


@query("amp_phase", f"""with {COEF}, a as (select *, sqrt(re * re + im * im) as amp, sqrt(1 / 32) as e from cf)
select shot, i, 'n=' || n as label, {r('amp')} as amplitude, {r('sqrt((re * e) ** 2 + (im * e) ** 2) / amp')} as amplitude_error, {r('degrees(atan2(im, re))')} as phase,
  {r('degrees(sqrt((re * e) ** 2 + (im * e) ** 2) / (amp * amp))', 4)} as phase_error from a""")
def amp_phase(spark, sf):
    d = spatial.amplitude_phase(ring_rows(spark, sf))
    return out(d.select("shot", "i", "label", "amplitude", "amplitude_error", "phase", "phase_error"), 6, phase_error=4)


@query("phase_visible", f"""with {COEF}, p as (select shot, n, quantile_cont(sqrt(re * re + im * im), 0.9) as p90 from cf group by all)
select shot, n - 1 as mode, {r('p90')} as p90, p90 > 0.1 * max(p90) over (partition by shot) as visible from p""")
def phase_visible(spark, sf):
    return out(summaries.phase_visible(ring_rows(spark, sf)))


@query("largest_modes", f"""with {COEF}, p as (select shot, n, max(sqrt(re * re + im * im)) as peak from cf group by all),
k as (select *, row_number() over (partition by shot order by peak desc, n) as rank from p) select shot, n, {r('peak')} as peak, rank from k where rank <= 2""")
def largest_modes(spark, sf):
    return out(summaries.top_modes(ring_rows(spark, sf), k=2).select("shot", F.col("n").cast("int").alias("n"), "peak", "rank"))


@query("fit_quality", f"""with {COEF}, ft as (select label as shot, i, p, any_value(v) as v, sum(re * cos(n * radians(phi)) + im * sin(n * radians(phi))) as fit from r64 join cf on cf.i = r64.vec_id group by label, i, p),
c as (select shot, i, sum((v - fit) ** 2) / 58 as chi from ft group by all)
select shot, 1e0 as raw_cn, 1e0 as eff_cn, 'good' as quality, {r('avg(chi)')} as mean_chi, 64 as channels, 3 as modes from c group by shot""")
def fit_quality(spark, sf):
    samples, inv, meta, coef = ring_fit(spark, sf)
    chi = spatial.chi_square(coef, inv, MODES).groupBy("shot").agg(F.avg("red_chi_sq").alias("mean_chi"))
    d = meta.join(chi, "shot")
    return out(d.select("shot", "raw_cn", "eff_cn", X.k_quality("raw_cn").alias("quality"), "mean_chi", F.col("n_sensors").alias("channels"), F.size("mode_n").alias("modes")))


# ---- maps ------------------------------------------------------------------------------------------------
@query("reconstruct_map", f"""with {COEF} select shot, i, 45 * a::double as x, 90 * b::double as y, {r('1e4 * sum(re * cos(n * radians(45 * a)) + im * sin(n * radians(45 * a)))', 4)} as z
from cf, range(0, 9) s(a), range(0, 5) t(b) group by shot, i, a, b""")
def reconstruct_map(spark, sf):
    return out(spatial.field_map(ring_rows(spark, sf), ["shot", "i"], phi_points=9, theta_points=5), 4)


PHIT = f"""{COEF}, z as (select shot, i, 5.0e0 * a as x, sum(re * cos(n * radians(5 * a)) + im * sin(n * radians(5 * a))) as z from cf, range(0, 73) s(a) group by shot, i, a)"""


def phi_time(spark, sf):
    return spatial.phi_time_map(ring_rows(spark, sf), ["shot", "i"], scale=1.0)


@query("phi_t", f"with {PHIT} select shot, i, x, {r('z')} as z from z")
def phi_t(spark, sf):
    return out(phi_time(spark, sf).drop("y"))


@query("theta_t", f"""with {COEF} select shot, i, -180 + 30.0e0 * a as y, {r('sum(re * cos(n * radians(40)) + im * sin(n * radians(40)))')} as z from cf, range(0, 13) s(a) group by shot, i, a""")
def theta_t(spark, sf):
    return out(spatial.theta_time_map(ring_rows(spark, sf), ["shot", "i"], phi=40.0, points=13).drop("x"))


@query("phi_peak_rms", f"""with {PHIT}, q as (select *, row_number() over (partition by shot, i order by round(z, 9) desc, x) as rn from z)
select shot, i, max(x) filter (rn = 1) as phi_peak, {r('sqrt(avg(z * z))')} as rms from q group by all""")
def phi_peak_rms(spark, sf):
    z = phi_time(spark, sf)
    peak = summaries.angle_of_peak(z.withColumn("z", F.round("z", 9)), ["shot", "i"], "x")
    return out(peak.join(summaries.rms_over_angle(z, ["shot", "i"]), ["shot", "i"]))


@query("colour_range", f"with {PHIT} select shot, {r('quantile_cont(abs(z), 0.99)')} as p99, {r('max(abs(z))')} as top from z group by shot")
def colour_range(spark, sf):
    z = cut_lineage(phi_time(spark, sf).select("shot", "z"))  # read four times
    return out(summaries.colour_range(z, ["shot"], p=0.99).withColumnRenamed("zmax", "p99").join(summaries.colour_range(z, ["shot"]).withColumnRenamed("zmax", "top"), "shot"))


# ---- bases --------------------------------------------------------------------------------------------------
SENSORS = """sn as (select p_partkey as shot, 'k' || (p_partkey % 50) as channel, p_size * 7.0e0 as phi_end1, p_size * 7.0e0 + 4 + p_partkey % 5 as phi_end2,
  (p_partkey % 90) * 1.0e0 as theta_end1, (p_partkey % 90) + 6.0e0 as theta_end2 from part)"""


def part_sensors(spark, sf):
    k, p = F.col("p_partkey"), F.col("p_size") * 7.0
    return table(spark, sf, "part").select(k.alias("shot"), F.concat(F.lit("k"), k % 50).alias("channel"), p.alias("phi_end1"), (p + 4 + k % 5).alias("phi_end2"),
                                           ((k % 90) * 1.0).alias("theta_end1"), (k % 90 + 6.0).alias("theta_end2"))


@query("sinusoid_basis", f"""with {SENSORS}, q as (select *, n, m, radians(phi_end1) as a, radians(phi_end2) as b, radians(theta_end1) as c, radians(theta_end2) as d
  from sn, (values (1, 0), (0, 2), (2, -3)) t(n, m)),
w as (select shot, channel, n, m, a, b, c, d, case when n = 0 then 1 else (sin(n * b) - sin(n * a)) / (n * (b - a)) end as xr, case when n = 0 then 0 else (cos(n * a) - cos(n * b)) / (n * (b - a)) end as xi,
  case when m = 0 then 1 else (sin(m * d) - sin(m * c)) / (m * (d - c)) end as yr, case when m = 0 then 0 else (cos(m * c) - cos(m * d)) / (m * (d - c)) end as yi from q)
select shot, channel, n, m, {r('xr * yr - xi * yi')} as re, {r('xr * yi + xi * yr')} as im, {r('cos(n * (a + b) / 2 + m * (c + d) / 2)')} as point_re from w""")
def sinusoid_basis(spark, sf):
    d = part_sensors(spark, sf)
    items = []
    for n, m in ((1, 0), (0, 2), (2, -3)):
        re, im = spatial.sinusoid(n, m)
        pr, _ = spatial.sinusoid(n, m, "sinusoidal-point")
        items.append(F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), re.alias("re"), im.alias("im"), pr.alias("point_re")))
    return out(d.select("shot", "channel", F.inline(F.array(*items))))


@query("gaussian_basis", """with s as (select r_regionkey as shot, s_suppkey, (s_suppkey * 37 % 360) * 1.0e0 as p, (s_suppkey * 11 % 60) * 1.0e0 as t from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
e as (select shot, min(p - 2) as xa, max(p + 2) as xb from s group by shot),
l as (select shot, case when ceil(xb / 10) * 10 - trunc(xa / 10) * 10 > 180 then 0 else trunc(xa / 10) * 10 end as lo, case when ceil(xb / 10) * 10 - trunc(xa / 10) * 10 > 180 then 360 else ceil(xb / 10) * 10 end as hi, ceil(xb / 10) * 10 - trunc(xa / 10) * 10 > 180 as wide from e),
c as (select shot, lo + j * (hi - lo) / (case when wide then 6 else 5 end) as n, (hi - lo) / (case when wide then 6 else 5 end) as eps from l, range(0, 6) t(j)),
k as (select c.*, greatest(1, floor(8 * eps / 360)) as cyc from c)
select s.shot, s_suppkey::varchar as channel, round(n, 6) + 0.0 as n, round(sum(exp(-(((n + o * 360 - p) / eps) ** 2))), 6) + 0.0 as v
from s join k on k.shot = s.shot, range(-3, 4) t(o) where abs(o) <= cyc group by s.shot, s_suppkey, n""")
def gaussian_basis(spark, sf):
    sensors = supplier_sensors(spark, sf)
    terms = spatial.gaussian_terms(sensors, spatial.rbf_centres(sensors))
    return out(terms.select("shot", "channel", "n", "v"))


def supplier_sensors(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    d = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    p, t = (F.col("s_suppkey") * 37 % 360) * 1.0, (F.col("s_suppkey") * 11 % 60) * 1.0
    return d.select(F.col("n_regionkey").alias("shot"), F.col("s_suppkey").cast("string").alias("channel"), p.alias("phi"), (p - 2).alias("phi_end1"), (p + 2).alias("phi_end2"),
                    (t - 1).alias("theta_end1"), (t + 1).alias("theta_end2"), F.lit(1.0).alias("sigma"))


@query("gaussian_integral_basis")
def gaussian_integral_basis(spark, sf):
    sensors = supplier_sensors(spark, sf)
    terms = spatial.gaussian_terms(sensors, spatial.rbf_centres(sensors, 6, 2), "gaussian-integral")
    return out(terms.select("shot", "channel", "n", "m", "v"))


@query("sigma_fill", """with s as (select p_brand as shot, p_partkey, case when p_size % 7 = 0 then null when p_size % 5 = 0 then -1 else p_size end::double as s from part)
select shot, p_partkey, round(case when s > 0 then s else coalesce(avg(s) filter (s > 0) over (partition by shot), 1) end, 6) + 0.0 as sigma from s""")
def sigma_fill(spark, sf):
    size = F.col("p_size")
    d = table(spark, sf, "part").select(F.col("p_brand").alias("shot"), "p_partkey", F.when(size % 7 == 0, None).when(size % 5 == 0, -1.0).otherwise(size.cast("double")).alias("sigma"))
    return out(spatial.fill_sigma(d).select("shot", "p_partkey", "sigma"))


@query("condition_number")
def condition_number(spark, sf):
    """Resolvability of each region's sensor angles."""
    return out(spatial.condition_number(supplier_sensors(spark, sf)))


@query("spatial_fit_rbf")
def spatial_fit_rbf(spark, sf):
    sensors = spatial.basis_rows(ring_sensors(spark, sf), basis="gaussian-point")
    inv = spatial.invert_design(sensors)
    coef = spatial.fit_coefficients(ring_samples(spark, sf), inv, 6)
    return out(spatial.mode_rows(coef, spatial.fit_meta(inv), 6).select("shot", "i", "mode", "n", "m", "re"))
