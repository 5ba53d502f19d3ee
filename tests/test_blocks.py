"""Steps on long records: linear fills and exact thinning."""
import math
import re

import pytest
from pyspark.sql import functions as F

from ringwave.operators import align, blocks, condition, modes, spectra, summaries


@pytest.mark.parametrize("n", [28, 92, 43704])
def test_thin_path_takes_every_listed_point(spark, n):
    """Of these sizes a rounded quotient loses a point."""
    got = summaries.thin_path(spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("ord")), 20, ["k"])
    assert sorted(r.ord for r in got.select("ord").collect()) == [math.floor(j * (n / 20)) for j in range(20)] + [n - 1]


def test_fill_reads_no_frame_to_the_last_row(spark):
    """Known every seventh row; frames that end at the last row are read anew for every row of a block."""
    d = spark.range(700).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))
    got = blocks.fill_known(d, ["k"], F.col("id"), F.floor(F.col("id") / 50), "v", previous="p", following="f")
    for r in got.collect():
        below, above = (r.id - 3) // 7 * 7 + 3, -((3 - r.id) // 7) * 7 + 3
        assert (r.p, r.f) == (below if below >= 0 else None, above if above < 700 else None)
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_interpolation_inside_one_large_block(spark):
    """All samples and grid points in one block: 200,000 rows would be 2e10 steps if each looked at all that follow."""
    s = spark.range(100000).select(F.lit(1).alias("shot"), (F.col("id") * 2.0).alias("t_s"), (F.col("id") * 6.0).alias("value"))
    grid = spark.range(99999).select(F.lit(1).alias("shot"), (F.col("id") * 2.0 + 0.5).alias("t_s"))
    got = align.interpolate(s, grid, ["shot"], 1e9).select(F.max(F.abs(F.col("value") - 3.0 * F.col("t_s"))).alias("e"), F.count(F.lit(1)).alias("n")).first()
    assert got.n == 99999 and got.e < 1e-6


def test_one_long_recording_stays_spread_over_tasks(spark):
    """Joined by recording with its small tables, all its samples would go to one task and stay there."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        i = F.col("id")
        d = spark.range(0, 8000, numPartitions=8).select(
            F.lit(1).alias("shot"), F.concat(F.lit("p"), i % 2).alias("channel"), F.floor(i / 2).alias("i"),
            (F.floor(i / 2) * 1e-5).alias("t_s"), (i * 1.0).alias("value"))
        clock = spark.createDataFrame([(1, 4000, 1e-5)], "shot int, n long, dt double")
        angles = spark.createDataFrame([(1, "p0", 0.0), (1, "p1", 90.0)], "shot int, channel string, phi double")
        spec = d.select("shot", "channel", F.col("i").alias("frame"), F.lit(1).alias("k"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
        arrays = spec.select("shot", "channel", "frame", F.lit(0).alias("k_lo"), F.array("re").alias("re"), F.array("im").alias("im"))
        pair = spark.createDataFrame([(1, "p0", "p1", 90.0)], "shot int, ch1 string, ch2 string, delta_phi double")
        steps = {
            "stack": align.stack(d), "reindex": align.reindex(d), "detrend": condition.detrend(d, "baseline", [(0.0, 1.0)]),
            "band_filter": condition.band_filter(d, clock, 0.0, 1e9), "gram": condition.gram(align.stack(d)),
            "mode_map": modes.mode_map(spec, angles, 1), "pairs": spectra.pair_products_of_frames(arrays, pair)}
        for name, got in steps.items():
            plan = got._jdf.queryExecution().executedPlan().toString()
            joins = re.findall(r"SortMergeJoin \[([^\]]*)\]", plan)
            assert all({"frame"} & set(re.findall(r"(\w+)#", x)) for x in joins), (name, joins)
        assert align.stack(d).select(F.spark_partition_id()).distinct().count() == 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_numbering_gives_a_task_no_more_of_more_rows(spark, monkeypatch):
    """In 8 shuffle partitions a task would hold an eighth of the rows, however many there are."""
    monkeypatch.setattr(blocks, "ROWS", 500)
    d = spark.range(20000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("t"))
    got = blocks.row_index(d, ["k"], ["t"], F.floor(F.col("t") / 25), rows=20000)
    assert got.where("i <> t").count() == 0 and got.count() == 20000
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500


def test_colour_range_makes_its_map_once(spark):
    import workload

    got = workload.QUERIES["colour_range"](spark, "/root/testdata/sf0.001")
    assert "posexplode(" not in got._jdf.queryExecution().executedPlan().toString()
