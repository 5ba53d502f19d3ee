"""Which probes serve which analysis: ordered preference groups per recording."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIDPLANE = 20.0  # fixed: degrees around theta = 0 counted as midplane


def by_family(sensors: DataFrame, groups: Sequence[Sequence[str]], angle: str = "phi", where: Column | None = None) -> DataFrame:
    """Candidates (shot, pref, channel, phi, theta) from family tokens, one preference per group."""
    d = sensors if where is None else sensors.where(where)
    prefs = F.array_compact(F.array(*[F.when(F.col("family").isin(*g), j) for j, g in enumerate(groups)]))
    return d.where(F.col(angle).isNotNull()).select("shot", "channel", "phi", "theta", F.explode(prefs).alias("pref"))


def by_set(sensors: DataFrame, flat_sets: DataFrame, word: str) -> DataFrame:
    """Candidates from list sets whose name contains ``word``; each set is a preference, all together the last."""
    named = flat_sets.where(F.lower("set_name").contains(word))
    order = named.groupBy("device_id", "set_name").agg(F.min("path").alias("path"))
    ranks = order.groupBy("device_id").agg(F.array_sort(F.collect_list("set_name")).alias("_all"))
    d = named.join(ranks, "device_id").withColumn("pref", F.array_position("_all", F.col("set_name")).cast("int"))
    both = d.select("device_id", F.col("member").alias("channel"), "pref").unionByName(
        d.where(F.size("_all") > 1).select("device_id", F.col("member").alias("channel"), F.lit(1 << 20).alias("pref")).distinct())
    return sensors.join(both, ["device_id", "channel"]).select("shot", "channel", "phi", "theta", "pref")


def default_arrays(sensors: DataFrame) -> dict[str, DataFrame]:
    """Candidate tables of the original device. ``sensors`` carry a genuine ``theta`` or NULL."""
    midplane = (F.col("theta") < MIDPLANE) | (F.col("theta") > 360.0 - MIDPLANE)
    array = by_family(sensors, [["MPI_BDOT"]]).unionByName(
        by_family(sensors, [["MPID"]], where=midplane).withColumn("pref", F.lit(1)))
    return {
        "pair": by_family(sensors, [["MPI_BDOT"], ["MPID"], ["MPI_BDOT", "MPID", "MPIF"]]),
        "toroidal": array,
        "grid": by_family(sensors, [["MPID"], ["MPI_BDOT"]]),
        "poloidal": by_family(sensors, [["MPID"]], angle="theta"),
    }
