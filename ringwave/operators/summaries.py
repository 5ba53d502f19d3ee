"""Small reductions used by the result products."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringwave.operators import blocks


def percentile_or_empty(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "pct") -> DataFrame:
    """Linear percentile with p clamped to 0..100; a key without values gives minus infinity."""
    keys = list(keys)
    got = blocks.exact_percentile(df, keys, value, min(100.0, max(0.0, p)) / 100.0, name)
    return df.select(*keys).distinct().join(got, keys, "left").withColumn(name, F.coalesce(name, F.lit(float("-inf"))))


def colour_range(df: DataFrame, keys: Sequence[str], value: str = "z", p: float | None = None) -> DataFrame:
    """Symmetric colour limit: the largest magnitude, or a percentile of the magnitudes; 1 when zero."""
    keys = list(keys)
    d = df.withColumn("_m", F.abs(value))
    lim = d.groupBy(*keys).agg(F.max("_m").alias("zmax")) if p is None else blocks.exact_percentile(d, keys, "_m", p, "zmax")
    return lim.withColumn("zmax", F.when(F.col("zmax") == 0, 1.0).otherwise(F.col("zmax")))


def angle_of_peak(df: DataFrame, keys: Sequence[str], angle: str, value: str = "z") -> DataFrame:
    """Angle of the largest signed value per time column; NULLs skipped, first angle wins."""
    return df.groupBy(*keys).agg(
        F.coalesce(F.max_by(angle, F.when(F.col(value).isNotNull(), F.struct(F.col(value), -F.col(angle)))), F.min(angle)).alias("phi_peak"))


def rms_over_angle(df: DataFrame, keys: Sequence[str], value: str = "z") -> DataFrame:
    return df.groupBy(*keys).agg(F.sqrt(F.avg(F.coalesce(F.col(value), F.lit(0.0)) ** 2)).alias("rms"))


def phase_visible(rows: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Modes whose 90th-percentile amplitude exceeds a tenth of the largest one."""
    keys = list(keys)
    d = rows.withColumn("_a", F.hypot("re", "im"))
    p90 = blocks.exact_percentile(d, [*keys, "mode"], "_a", 0.9, "p90")
    top = p90.groupBy(*keys).agg(F.max("p90").alias("_top"))
    return p90.join(top, keys).select(*keys, "mode", "p90", (F.col("p90") > 0.1 * F.col("_top")).alias("visible"))


def family_summary(sensors: DataFrame, keys: Sequence[str] = ("device_id",)) -> DataFrame:
    """Count, kind and shape per family with the place where the family first appears."""
    return sensors.groupBy(*keys, "family").agg(
        F.min_by("kind", "ord").alias("kind"), F.min_by("shape", "ord").alias("shape"),
        F.count(F.lit(1)).alias("count"), F.min("ord").alias("first_seen"))


def top_by_swing(df: DataFrame, keys: Sequence[str], channel: str, value: str, k: int = 6) -> DataFrame:
    """The k channels with the largest peak-to-peak value; one row per channel enters the ranking."""
    keys = list(keys)
    swing = df.groupBy(*keys, channel).agg((F.max(value) - F.min(value)).alias("swing"))
    w = Window.partitionBy(*keys).orderBy(F.desc("swing"), channel)
    return swing.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_modes(rows: DataFrame, keys: Sequence[str] = ("shot",), k: int = 6) -> DataFrame:
    keys = list(keys)
    peak = rows.groupBy(*keys, "mode", "n", "m").agg(F.max(F.hypot("re", "im")).alias("peak"))
    w = Window.partitionBy(*keys).orderBy(F.desc("peak"), "mode")
    return peak.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def widest_pair(candidates: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """First and last probe by angle of the best preference group with a non-zero gap.

    ``candidates``: keys, pref, channel, phi. Aggregations only, no pairs are formed.
    """
    keys = list(keys)
    lo, hi = F.struct("phi", "channel"), F.struct("phi", "channel")
    g = candidates.groupBy(*keys, "pref").agg(
        F.min_by("channel", lo).alias("ch1"), F.min("phi").alias("phi1"), F.max_by("channel", hi).alias("ch2"), F.max("phi").alias("phi2"),
        F.count(F.lit(1)).alias("n_probes"))
    ok = g.where(F.col("phi1") != F.col("phi2"))
    best = ok.groupBy(*keys).agg(F.min_by(F.struct("pref", "ch1", "phi1", "ch2", "phi2", "n_probes"), "pref").alias("b"))
    return best.select(*keys, "b.*", (F.col("b.phi2") - F.col("b.phi1")).alias("delta_phi"))


def usable_array(candidates: DataFrame, keys: Sequence[str] = ("shot",), min_probes: int = 4, distinct: bool = True) -> DataFrame:
    """Members of the first preference group with enough probes at distinct angles."""
    keys = list(keys)
    g = candidates.groupBy(*keys, "pref").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.round("phi", 1)).alias("_d"))
    g = g.where((F.col("_n") >= min_probes) & (F.col("_d") >= (min_probes if distinct else 1)))
    pick = g.groupBy(*keys).agg(F.min("pref").alias("pref"))
    return candidates.join(pick, [*keys, "pref"])


def channel_usage(channels: DataFrame, roles: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Every channel with the roles that use it; an idle channel has an empty list."""
    keys = list(keys)
    r = roles.groupBy(*keys, "channel").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return channels.join(r, [*keys, "channel"], "left").select(
        *keys, "channel", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), F.col("roles").isNotNull().alias("used"))


def usage_totals(usage: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.count_if("used").alias("n_used"))


def thin_path(points: DataFrame, n: int, keys: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """At most ``n`` evenly taken points of a path plus its last one."""
    keys = list(keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = points.join(size, keys)
    step = F.col("_n") / n
    near = F.floor(F.col(ord_col) / step)  # the quotient is rounded, so its neighbours are tried as well
    taken = F.lit(False)
    for j in (near - 1, near, near + 1, near + 2):
        taken = taken | ((F.floor(j * step) == F.col(ord_col)) & j.between(0, n - 1))
    last = F.col(ord_col) == F.col("_n") - 1
    copies = F.when(F.col("_n") <= n, 1).otherwise(F.when(taken, 1).otherwise(0) + F.when(last, 1).otherwise(0))
    return d.withColumn("_c", F.explode(F.array_repeat(F.lit(1), copies))).drop("_n", "_c")


def display_columns(df: DataFrame, cap: int, keys: Sequence[str] = ("shot",), idx: str = "frame") -> DataFrame:
    """At most ``cap`` evenly spaced columns of a gap-free index, ends included."""
    from ringwave.operators.modes import even_slices

    keys = list(keys)
    bounds = df.groupBy(*keys).agg(F.lit(0).cast("long").alias("lo"), F.max(idx).cast("long").alias("hi"))
    pick = even_slices(bounds, cap, keys).withColumnRenamed("frame", idx)
    return df.join(pick, [*keys, idx], "left_semi")
