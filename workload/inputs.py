"""How the provided tables read as recordings, sensors, eras and sets; and the same as SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwave.operators import align, blocks
from ringwave.session import cut_lineage

DT = 1e-5  # step of the line-item recordings, s
N_FFT, HOP = 64, 32
EPOCH = 1704067200  # 2024-01-01
DAY_US = 86400 * 1000000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- line items: three long recordings of seven probes, one sample per row ---------------------
def line_samples(spark: SparkSession, sf: str) -> DataFrame:
    """shot = return flag, channel = line number, index = shipping order, value = price / 1000."""
    order = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    items = table(spark, sf, "lineitem")
    d = items.select("l_returnflag", "l_linenumber", *order)
    d = d.withColumns({"shot": (F.ascii("l_returnflag") - 64).cast("long"), "channel": F.concat(F.lit("p"), F.col("l_linenumber"))})
    month = F.floor(micros("l_shipdate") / (30 * DAY_US))
    d = blocks.row_index(d, ["shot", "channel"], order, month, rows=items.count())
    return d.select("shot", "channel", "i", (F.col("i") * DT).alias("t_s"), (F.col("l_extendedprice") / 1000).alias("value"))


def stacked_lines(spark: SparkSession, sf: str) -> DataFrame:
    return align.stack(cut_lineage(line_samples(spark, sf)))


def line_angles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.concat(F.lit("p"), n).alias("channel"), ((n - 1) * 360 / 7).alias("phi")).distinct()


LI = """li0 as (
  select ascii(l_returnflag) - 64 as shot, 'p' || l_linenumber as channel, (l_linenumber - 1) * 360 / 7 as phi,
         row_number() over (partition by l_returnflag, l_linenumber
           order by l_shipdate, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i,
         l_extendedprice / 1000 as value
  from lineitem),
ln as (select shot, min(n) as n from (select shot, channel, count(*) as n from li0 group by all) group by shot),
li as (select li0.*, i * 1e-5 as t_s, n from li0 join ln using (shot) where i < n)"""


def spectrum_sql(src: str = "li", n_fft: int = N_FFT, hop: int = HOP, k_lo: int = 0, k_hi: int = N_FFT // 2, name: str = "ls") -> str:
    w = f"(0.5 - 0.5 * cos(2 * pi() * j / {n_fft}))"
    a = f"(2 * pi() * ((k * j) % {n_fft}) / {n_fft})"
    return f"""{name}n as (select shot, channel, count(*) as cn from {src} group by all),
{name}f as (
  select shot, channel, frame, i - frame * {hop} as j, value
  from (select s.shot, s.channel, s.i, s.value, cn, unnest([s.i // {hop} - 1, s.i // {hop}]) as frame
        from {src} s join {name}n using (shot, channel))
  where frame >= 0 and frame <= (cn - {n_fft}) // {hop}),
{name}m as (select *, value - avg(value) over (partition by shot, channel, frame) as v from {name}f),
{name} as (
  select shot, channel, frame, k, sum(v * {w} * cos({a})) as re,
         -sum(case when (2 * k) % {n_fft} = 0 then 0.0 else v * {w} * sin({a}) end) as im
  from {name}m, range({k_lo}, {k_hi + 1}) t(k) group by all)"""


LINE_SPECTRA = f"{LI},\n{spectrum_sql()}"
PAIRS = f"""{LINE_SPECTRA},
lx as (
  select a.shot, a.channel as ch1, b.channel as ch2, cast(substr(b.channel, 2) as int) as line, a.frame, a.k,
         b.re * a.re + b.im * a.im as xre, case when a.k in (0, 32) then 0.0 else b.re * a.im - b.im * a.re end as xim,
         a.re * a.re + a.im * a.im as p1, b.re * b.re + b.im * b.im as p2
  from ls a join ls b on a.shot = b.shot and a.frame = b.frame and a.k = b.k and a.channel = 'p1' and b.channel <> 'p1')"""


# ---- events: many short recordings with irregular clocks --------------------------------------------
def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """shot = user / 8, channel = user % 8, index = order in time, t_real = seconds since 2024."""
    events = table(spark, sf, "events")
    d = events.select("user_id", "event_id", "event_type", "ts", "value")
    us = micros("ts")
    d = d.withColumns({"shot": F.floor(F.col("user_id") / 8), "channel": F.concat(F.lit("c"), F.col("user_id") % 8)})
    d = blocks.row_index(d, ["shot", "channel"], ["ts", "event_id"], F.floor(us / (7 * DAY_US)), rows=events.count())
    return d.select("shot", "channel", "i", (F.col("i") * 1e-3).alias("t_s"), ((us - EPOCH * 1000000) / 1e6).alias("t_real"), "value", "event_type", "event_id")


EV = """ev as (
  select user_id // 8 as shot, 'c' || (user_id % 8) as channel, 45.0 * (user_id % 8) as phi, event_id, event_type, value,
         row_number() over (partition by user_id order by ts, event_id) - 1 as i,
         (row_number() over (partition by user_id order by ts, event_id) - 1) * 1e-3 as t_s,
         (epoch_us(ts) - 1704067200000000) / 1e6 as t_real
  from events)"""


# ---- embeddings: ring snapshots ----------------------------------------------------------------------
def ring64(spark: SparkSession, sf: str) -> DataFrame:
    """64 real probes per vector."""
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", "label", F.posexplode("embedding").alias("p", "v"))
    return d.select("vec_id", "label", "p", F.col("v").cast("double").alias("v"), (F.col("p") * 5.625).alias("phi"))


def ring32(spark: SparkSession, sf: str) -> DataFrame:
    """32 complex probes per vector: neighbouring entries are real and imaginary part."""
    e = table(spark, sf, "embeddings")
    d = e.select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p"))
    return d.select("vec_id", "label", "p", F.get("embedding", 2 * F.col("p")).cast("double").alias("re"),
                    F.get("embedding", 2 * F.col("p") + 1).cast("double").alias("im"), (F.col("p") * 11.25).alias("phi"))


R64 = """r64 as (select vec_id, label, p, embedding[p + 1]::double as v, p * 5.625 as phi from embeddings, range(0, 64) t(p))"""
R32 = """r32 as (select vec_id, label, p, embedding[2 * p + 1]::double as re, embedding[2 * p + 2]::double as im,
  p * 11.25 as phi from embeddings, range(0, 32) t(p))"""


def ring_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The ring as recordings: shot = label, time index = vector id."""
    return ring64(spark, sf).select(F.col("label").cast("long").alias("shot"), F.format_string("%02d", "p").alias("channel"),
                                    F.col("vec_id").alias("i"), (F.col("vec_id") * 1e-3).alias("t_s"), F.col("v").alias("value"))


def ring_sensors(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor table of the ring: one degree wide in phi, two in theta."""
    labels = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("shot")).distinct()
    d = labels.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    phi = F.col("p") * 5.625
    return d.select("shot", F.format_string("%02d", "p").alias("channel"), phi.alias("phi"), (phi - 0.5).alias("phi_end1"), (phi + 0.5).alias("phi_end2"),
                    F.lit(-1.0).alias("theta_end1"), F.lit(1.0).alias("theta_end2"), F.lit(1.0).alias("sigma"))
