"""Connected components of a distributed edge list."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwave.session import cut_lineage


def _to_smallest(links: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours (or only its larger or smaller ones) linked to its smallest neighbour.

    Neighbourhoods are never collected: the smallest comes from an aggregation and is joined back.
    """
    if larger_only:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = both.join(least, "u")
    if larger_only:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each linked node reaches, by alternating stars.

    Each round links all larger neighbours, then all smaller ones, to a node's smallest neighbour. It ends
    when a round changes nothing, after a number of rounds logarithmic in the longest path. Rounds are
    written to the shared folder; only their counts come to the driver. Null ends link nothing.
    """
    links = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = cut_lineage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
        links = cut_lineage(_to_smallest(_to_smallest(links, True), False))
