"""The result products over one archive made of the line-item recordings."""
from __future__ import annotations

from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.plans import products
from ringwave.plans.products import Archive
from workload.inputs import LI, line_samples, spectrum_sql, table
from workload.registry import out, query, r

R0, A0 = 1.69, 0.7


def archive(spark, sf) -> Archive:
    """Seven probes that stand at the same angle both ways around; every recording has all of them."""
    samples = line_samples(spark, sf).select("shot", "channel", "i", (F.col("t_s") * 1e3).alias("t_ms"), "value")
    n = F.col("l_linenumber")
    angle = (n - 1) * 360 / 7
    d = table(spark, sf, "lineitem").select((F.ascii("l_returnflag") - 64).cast("long").alias("shot"), F.concat(F.lit("p"), n).alias("channel"), angle.alias("phi")).distinct()
    theta = F.radians("phi")
    sensors = d.withColumns({
        "theta": F.col("phi"), "device_id": F.lit("d"), "family": F.lit("MPID"), "kind": F.lit(X.FAMILY_KIND["MPID"]),
        "r": R0 + A0 * F.cos(theta), "z": A0 * F.sin(theta), "length": F.lit(0.1), "tilt": F.lit(90.0), "delta_phi": F.lit(2.0)})
    sensors = sensors.withColumns(X.endpoint_columns(R0)).withColumn("shape", X.sensor_shape("delta_phi"))
    probes = sensors.select("shot", F.lit(0).alias("pref"), "channel", "phi", "theta")
    return Archive(samples, sensors, {"pair": probes, "toroidal": probes, "grid": probes, "poloidal": probes})


#: Fit products need a window in ms; this one holds every sample of any record.
WINDOW = {"t_lo": 0.0, "t_hi": 1e12}
FITS = ("qs_fit", "phi_t", "amplitude", "phase_t", "fit_quality", "chi_sq_t", "fit_signals", "fit_residuals", "signal_conditioning")


def _product(name: str, sql: str | None = None, **params):
    @query(f"product_{name}", sql)
    def run(spark, sf):
        return out(products.build(archive(spark, sf), name, **params))

    return run


GEO = """geo as (select distinct ascii(l_returnflag) - 64 as shot, 'p' || l_linenumber as channel, (l_linenumber - 1) * 360 / 7 as phi from lineitem)"""
_product("geometry", f"""with {GEO} select shot, channel as name, 'MPID' as family, '{X.FAMILY_KIND["MPID"]}' as kind, 'point' as shape, {r('phi')} as phi, {r('phi')} as theta,
  {r(f'{R0} + {A0} * cos(radians(phi))')} as r, {r(f'{A0} * sin(radians(phi))')} as z, 0.1::double as length, 2.0::double as delta_phi, 90.0::double as tilt from geo""")

#: The widest pair by listed angle is p1 with p7. Frames of 1 ms are 100 samples.
LI_PAIR = LI.replace("from lineitem)", "from lineitem where l_linenumber in (1, 7))")  # the pair's own common length
PAIR_100 = f"""{LI_PAIR}, {spectrum_sql('li', 100, 50, 0, 50, 'ps')},
px as (select a.shot, a.frame, a.k, b.re * a.re + b.im * a.im as xre, case when a.k in (0, 50) then 0.0 else b.re * a.im - b.im * a.re end as xim,
  a.re * a.re + a.im * a.im as p1, b.re * b.re + b.im * b.im as p2
  from ps a join ps b on a.shot = b.shot and a.frame = b.frame and a.k = b.k and a.channel = 'p1' and b.channel = 'p7'),
pw as (select p.shot, p.frame, p.k, p.xre, p.xim, q.xre as sx, q.xim as sy, q.p1 as s1, q.p2 as s2 from px p, range(-2, 3) t(o) join px q
  on q.shot = p.shot and q.frame = p.frame and q.k = (case when p.k + o < 0 then -1 - (p.k + o) when p.k + o > 50 then 101 - (p.k + o) else p.k + o end)),
pc as (select shot, frame, k, sqrt(any_value(xre) ** 2 + any_value(xim) ** 2) as power,
  greatest(0, least(1, (avg(sx) ** 2 + avg(sy) ** 2) / (avg(s1) * avg(s2)))) as coherence from pw group by all)"""
CELL = f"shot, frame, {r('(frame * 50 + 50) * 1e-2')} as t_ms, k, k::double as f_khz"
_product("spectrogram", f"with {PAIR_100} select {CELL}, {r('log10(greatest(power, 1e-30))')} as z, 'p1' as ch1, 'p7' as ch2, {r('6 * 360 / 7')} as delta_phi from pc")
_product("coherence", f"with {PAIR_100} select {CELL}, {r('coherence')} as z, 'p1' as ch1, 'p7' as ch2 from pc")

for _name in ("n_spectrum", "mode_number", "phase_fit", "mode_shape", "mode_track"):
    _product(_name)
for _name in ("qs_fit", "amplitude", "fit_quality", "chi_sq_t", "fit_residuals"):
    _product(_name, **WINDOW)
