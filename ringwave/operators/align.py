"""Windows, decimation, common clocks, angle grids and channel corrections."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringwave.operators import blocks
from ringwave.operators.spectra import _col

SWAP_AFTER_SHOT = 177705  # fixed: recordings after this one have the two probes below exchanged
SWAPPED_PAIR = ("ESLD66M079", "ESLD66M319")


# ---- windows and decimation ---------------------------------------------------------
def trim(df: DataFrame, lo=None, hi=None, t: str = "t_s") -> DataFrame:
    """Inclusive time window; a missing bound is open."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(t) >= _col(lo))
    if hi is not None:
        cond = cond & (F.col(t) <= _col(hi))
    return df.where(cond)


def padded_window(df: DataFrame, lo: float, hi: float, f_low: float, t: str = "t_s") -> DataFrame:
    """Window widened by one period of the high-pass corner on both sides."""
    pad = 0.0 if f_low == 0 else 1.0 / f_low
    return trim(df, lo - pad, hi + pad, t)


def reindex(df: DataFrame, keys: Sequence[str] = ("shot", "channel"), i: str = "i") -> DataFrame:
    """Restart a gap-free index at zero after a trim."""
    start = df.groupBy(*keys).agg(F.min(i).alias("_i0"))
    return blocks.join_small(df, start, list(keys)).withColumn(i, F.col(i) - F.col("_i0")).drop("_i0")


def decimate(df: DataFrame, step, i: str = "i", *, renumber: bool = True) -> DataFrame:
    """Every ``step``-th sample of a zero-based index."""
    s = _col(step)
    d = df.where(F.col(i) % s == 0)
    return d.withColumn(i, F.floor(F.col(i) / s).cast("long")) if renumber else d


def decimation_step(step: int, policy_ok: Column, has_raw_derivative: Column) -> Column:
    """The requested stride, or 1 where the policy or a raw-derivative probe forbids it."""
    return F.when(policy_ok & ~has_raw_derivative, F.lit(step)).otherwise(F.lit(1))


def stack(samples: DataFrame, channels: DataFrame | None = None, keys: Sequence[str] = ("shot",), i: str = "i") -> DataFrame:
    """Chosen channels cut to the length they all share."""
    keys = list(keys)
    d = samples if channels is None else blocks.join_small(samples, channels, [c for c in channels.columns], "left_semi")
    length = d.groupBy(*keys, "channel").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min("_n").alias("n"))
    return blocks.join_small(d, length, keys).where(F.col(i) < F.col("n")).drop("n")


def cursor_window(df: DataFrame, lo: Column, hi: Column, min_rows: int, half_rows: int, keys: Sequence[str] = ("shot",),
                  t: str = "t_s", i: str = "i") -> DataFrame:
    """Rows inside [lo, hi]; with fewer than ``min_rows`` the rows around the record centre.

    One aggregated row per key decides between the two, so both cases are one plan.
    """
    keys = list(keys)
    inside = F.col(t).between(lo, hi)
    d = df.withColumn("_in", inside)
    stat = d.groupBy(*keys).agg(F.count_if("_in").alias("_hits"), F.count(F.lit(1)).alias("_n"))
    c = F.floor(F.col("_n") / 2)
    centre = (F.col(i) >= F.greatest(F.lit(0), c - half_rows)) & (F.col(i) < F.least(F.col("_n"), c + half_rows))
    return blocks.join_small(d, stat, keys).where(F.when(F.col("_hits") < min_rows, centre).otherwise(F.col("_in"))).drop("_in", "_hits", "_n")


# ---- nearest and interpolated lookup ---------------------------------------------------
def nearest(df: DataFrame, at: DataFrame, keys: Sequence[str], axis: str, target: str, payload: Sequence[str]) -> DataFrame:
    """The row nearest to each key's target value; ties go to the smaller axis value."""
    keys = list(keys)
    d = df.join(at, keys)
    pick = F.min_by(F.struct(axis, *payload), F.struct(F.abs(F.col(axis) - F.col(target)), F.col(axis)))
    return d.groupBy(*keys, target).agg(pick.alias("_p")).select(*keys, target, "_p.*")


def interpolate(samples: DataFrame, grid: DataFrame, keys: Sequence[str], width: float, t: str = "t_s", value: str = "value") -> DataFrame:
    """Linear interpolation of each series at its grid points, end values held.

    ``grid`` has keys and ``t``. Samples and grid points are bucketed by ``width``; only the last
    and first sample of each bucket cross bucket borders.
    """
    keys = list(keys)
    known = samples.select(*keys, F.col(t), F.lit(0).alias("_tag"), F.struct(F.col(t).alias("t"), F.col(value).cast("double").alias("v")).alias("_s"))
    asked = grid.select(*keys, F.col(t), F.lit(1).alias("_tag"), F.lit(None).cast(known.schema["_s"].dataType).alias("_s"))
    filled = blocks.fill_known(
        known.unionByName(asked), keys, F.struct(F.col(t), F.col("_tag")), F.floor(F.col(t) / width), "_s",
        previous="_p", following="_n",
    ).where(F.col("_tag") == 1)
    slope = (F.col("_n.v") - F.col("_p.v")) / (F.col("_n.t") - F.col("_p.t"))
    y = (
        F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_p.t") == F.col(t)), F.col("_p.v"))
        .otherwise(slope * (F.col(t) - F.col("_p.t")) + F.col("_p.v"))
    )
    return filled.select(*keys, t, y.alias(value))


def common_clock(samples: DataFrame, t: str = "t_s") -> DataFrame:
    """Per recording the densest channel's times inside the window all channels share."""
    per = samples.groupBy("shot", "channel").agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("a"), F.max(t).alias("b"))
    ref = per.groupBy("shot").agg(
        F.min_by("channel", F.struct(-F.col("n"), "channel")).alias("channel"), F.max("a").alias("lo"), F.min("b").alias("hi"))
    return blocks.join_small(samples, ref, ["shot", "channel"]).where(F.col(t).between(F.col("lo"), F.col("hi"))).select("shot", t)


def on_common_clock(samples: DataFrame, width: float, t: str = "t_s") -> DataFrame:
    """All channels of a recording interpolated onto its common clock."""
    channels = samples.select("shot", "channel").distinct()
    grid = blocks.join_small(common_clock(samples, t), channels, "shot")
    return interpolate(samples, grid, ["shot", "channel"], width, t)


def paired_traces(samples: DataFrame, names: Sequence[str], base: str, width: float, t: str = "t_s") -> DataFrame:
    """Context traces side by side on the clock of ``base`` (or of the first one present)."""
    d = samples.where(F.col("channel").isin(*names))
    order = F.when(F.col("channel") == base, 0)
    for j, n in enumerate(names):
        order = order.when(F.col("channel") == n, j + 1)
    ref = d.groupBy("shot").agg(F.min_by("channel", order).alias("channel"))
    clock = blocks.join_small(d, ref, ["shot", "channel"]).select("shot", t)
    grid = blocks.join_small(clock, d.select("shot", "channel").distinct(), "shot")
    aligned = interpolate(d, grid, ["shot", "channel"], width, t)
    return aligned.groupBy("shot", t).pivot("channel", list(names)).agg(F.first("value"))


# ---- angle grid ------------------------------------------------------------------------
def angle_weights(sensors: DataFrame, points: int = 73, keys: Sequence[str] = ("shot",), angle: str = "phi") -> DataFrame:
    """Interpolation weights of each sensor at a regular closed angle grid, periodic on both sides.

    Sensors per recording are few; the window only sees the geometry, never the samples.
    """
    keys = list(keys)
    step = 360.0 / (points - 1)
    w = Window.partitionBy(*keys).orderBy("_a", "channel")
    whole = Window.partitionBy(*keys)
    s = sensors.select(*keys, "channel", F.pmod(F.col(angle), F.lit(360.0)).alias("_a"))
    s = s.withColumn("_nx", F.coalesce(F.lead("_a").over(w), F.min("_a").over(whole) + 360.0)).withColumn(
        "_nc", F.coalesce(F.lead("channel").over(w), F.min_by("channel", F.struct("_a", "channel")).over(whole)))
    s = s.where(F.col("_nx") > F.col("_a"))
    lo, hi = F.ceil(F.col("_a") / step), F.ceil(F.col("_nx") / step) - 1
    g = s.where(lo <= hi).withColumn("_g", F.explode(F.sequence(lo, hi)))
    frac = (F.col("_g") * step - F.col("_a")) / (F.col("_nx") - F.col("_a"))
    turn = F.pmod(F.col("_g"), F.lit(points - 1))
    cells = F.when(turn == 0, F.array(F.lit(0), F.lit(points - 1))).otherwise(F.array(turn.cast("int")))
    g = g.select(*keys, "channel", "_nc", frac.alias("_f"), F.explode(cells).alias("g"))
    both = F.array(
        F.struct(F.col("channel").alias("channel"), (1.0 - F.col("_f")).alias("weight")),
        F.struct(F.col("_nc").alias("channel"), F.col("_f").alias("weight")),
    )
    return g.select(*keys, (F.col("g") * step).alias("angle"), F.inline(both)).where(F.col("weight") != 0)


def on_angle_grid(samples: DataFrame, weights: DataFrame, keys: Sequence[str] = ("shot",), along: Sequence[str] = ("i", "t_s")) -> DataFrame:
    """Field on the angle grid at every time: each sample feeds only the grid cells next to it."""
    return (
        samples.join(weights, [*keys, "channel"])
        .groupBy(*keys, *along, "angle").agg(F.sum(F.col("weight") * F.col("value")).alias("z"))
    )


# ---- corrections --------------------------------------------------------------------------
def compensate(samples: DataFrame, coils: DataFrame, coupling: DataFrame) -> DataFrame:
    """Subtract sum over coils of coil(t) * coupling; all or nothing per recording.

    A recording in which any channel lacks a coupling record stays as it is.
    """
    vacuum = coils.join(coupling, ["shot", "coil"]).groupBy("shot", "channel", "i").agg(
        F.sum(F.col("value") * F.col("dc_coupling")).alias("_vac"))
    lacking = samples.select("shot", "channel").distinct().join(
        coupling.select("shot", "channel").distinct(), ["shot", "channel"], "left_anti").select("shot").distinct()
    usable = coupling.select("shot").distinct().join(lacking, "shot", "left_anti").withColumn("_use", F.lit(True))
    d = blocks.join_small(samples, usable, "shot", "left").join(vacuum, ["shot", "channel", "i"], "left")
    v = F.when(F.col("_use"), F.col("value") - F.coalesce("_vac", F.lit(0.0))).otherwise(F.col("value"))
    return d.withColumn("value", v).select(*samples.columns)


def swap_pair(samples: DataFrame, first: str = SWAPPED_PAIR[0], second: str = SWAPPED_PAIR[1], after_shot: int = SWAP_AFTER_SHOT,
              where: Column | None = None) -> DataFrame:
    """Exchange two channels' signals in recordings after ``after_shot`` that hold both."""
    present = samples.where(F.col("channel").isin(first, second)).groupBy("shot").agg(F.count_distinct("channel").alias("_both"))
    cond = (F.col("_both") == 2) & (F.col("shot") > after_shot)
    if where is not None:
        cond = cond & where
    c = F.col("channel")
    other = F.when(c == first, second).when(c == second, first).otherwise(c)
    return blocks.join_small(samples, present, "shot", "left").withColumn("channel", F.when(F.coalesce(cond, F.lit(False)), other).otherwise(c)).drop("_both")
