"""Lake merge rules and the streaming jobs."""
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringwave.operators import catalog, condition
from ringwave.sources import device_files
from ringwave.sources.lake import channel_status, Lake, export
from ringwave.streaming import live

SHOT = "shot long, device_id string, device string, analysis string, backend string, source string, tmin double, tmax double, decimate int"


def samples(spark, names, scale=1.0, bad=()):
    n = 20
    rows = [pd.DataFrame({"shot": 7, "channel": c, "i": np.arange(n), "t_ms": np.full(n, np.nan) if c in bad else np.arange(n) * 0.1, "value": scale * np.arange(n)}) for c in names]
    return spark.createDataFrame(pd.concat(rows))


def shot(spark, analysis="rotating", tmin=None, decimate=1):
    return spark.createDataFrame([(7, "d", "D", analysis, "b", "s", tmin, None, decimate)], SHOT)


def test_lake_merge(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    with pytest.raises(ValueError):
        lake.ingest(0, samples(spark, ["x"], bad=["x"]), shot(spark))
    lake.ingest(1, samples(spark, ["a", "b", "x"], bad=["x"]), shot(spark))
    assert {r.channel: r.status for r in lake.channels().collect()} == {"a": "fetched", "b": "fetched", "x": "missing"}
    asked = spark.createDataFrame([(7, c, None, None, 1) for c in "abxc"], "shot long, channel string, tmin double, tmax double, decimate int")
    assert [r.channel for r in lake.pending(asked).collect()] == ["c"]
    lake.ingest(2, samples(spark, ["b", "c"], 10.0), shot(spark, "spatial"))
    assert lake.list_shots().select("n_channels", "analysis").first() == (3, "rotating+spatial")
    assert lake.load_data(7, "b").agg(F.max("value")).first()[0] == 190.0
    assert lake.samples().count() == 60
    lake.ingest(2, samples(spark, ["b", "c"], 10.0), shot(spark, "spatial"))  # replay
    assert lake.samples().count() == 60
    lake.ingest(3, samples(spark, ["a"]), shot(spark, tmin=5.0))  # another window replaces the recording
    assert [r.channel for r in lake.channel_names(7).collect()] == ["a"]
    export(lake.list_shots(), str(tmp_path / "out"), kind="line", node_id="n", params={"p": "1"})
    assert spark.read.parquet(str(tmp_path / "out")).first()["params_json"] == '{"p":"1"}'


def test_device_file(spark, tmp_path):
    dev = {"name": "Dev One", "R0": 1.5, "sensors": {"A": {"segments": [{"since_shot": 10, "phi": 1.0}, {"since_shot": 20, "pointname": "NotAvailable"}]}, "B": {"phi": 5.0, "r": 2.0}},
           "sensor_sets": {"one": {"type": "list", "sensors": ["A", "B"]}, "all": {"type": "composite", "sets": ["one", "all"]}}, "first_wall": {"segments": [{"since_shot": 0, "r": [1, 2]}]}}
    (tmp_path / "dev1.json").write_text(json.dumps(dev))
    raw = device_files.read(spark, str(tmp_path / "dev1.json"))
    seg = device_files.sensor_segments(raw)
    ask = spark.createDataFrame([("dev1", s, n) for s in "AB" for n in (9, 10, 15, 20)], "device_id string, sensor_id string, shot long")
    got = {(r.sensor_id, r.shot): r.phi for r in catalog.geometry_at(ask, seg).collect()}
    assert got == {("A", 10): 1.0, ("A", 15): 1.0, **{("B", n): 5.0 for n in (9, 10, 15, 20)}}
    near = {(r.sensor_id, r.shot): r.phi for r in catalog.geometry_nearest(ask, seg).collect()}
    assert near[("A", 9)] == 1.0 and near[("A", 20)] == 1.0
    flat = catalog.flatten_sets(spark, device_files.sensor_sets(raw))
    assert {r.member for r in flat.where("set_name = 'all'").collect()} == {"A", "B"}
    assert device_files.features(raw).count() == 1 and device_files.devices(raw).first()["r0"] == 1.5


def write_feed(spark, path, n=256):
    t0 = pd.Timestamp("2024-01-01")
    pdf = pd.concat([pd.DataFrame({"shot": 1, "channel": f"p{p}", "i": np.arange(n), "ts": t0 + pd.to_timedelta(np.arange(n), unit="ms"),
                                   "value": np.sin(2 * np.pi * 125 * np.arange(n) / 1000 - np.deg2rad(45 * p))}) for p in range(8)])
    spark.createDataFrame(pdf).repartition(1).write.parquet(path)
    return pdf


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).toPandas()


def test_sliding_spectra_and_causal_filter(spark, tmp_path):
    pdf = write_feed(spark, str(tmp_path / "feed"))
    schema = "shot long, channel string, i long, ts timestamp, value double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    spec = drain(live.sliding_spectra(stream, n_fft=64, rate=1000.0, ks=[7, 8, 9], late="10 milliseconds"), "spec")
    x = pdf[pdf.channel == "p1"].value.to_numpy()[:64]
    ref = np.fft.rfft((x - x.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)))[8]
    one = spec[(spec.channel == "p1") & (spec.k == 8) & spec.complete].sort_values("start").iloc[0]
    assert np.isclose(one.re + 1j * one.im, ref)
    seen = []
    angles = spark.createDataFrame([(f"p{p}", 45.0 * p) for p in range(8)], "channel string, phi double")
    q = live.live_mode_numbers(live.sliding_spectra(stream, n_fft=64, rate=1000.0, ks=[8], late="10 milliseconds", hop=64), angles, lambda d, _: seen.extend(d.collect()), 3).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen and {abs(r.n) for r in seen} == {1}
    y = drain(live.causal_filter(stream.select("shot", "channel", "i", "value"), 3.0), "smooth")
    got = y[y.channel == "p1"].sort_values("i").value.to_numpy()
    taps, v = condition.causal_taps(3.0), pdf[pdf.channel == "p1"].value.to_numpy()
    assert np.allclose(got, np.correlate(np.concatenate([np.full(len(taps) - 1, v[0]), v]), taps, mode="valid"))


def test_ingest_stream(spark, tmp_path):
    samples(spark, ["a", "b"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shot long, channel string, i long, t_ms double, value double").parquet(str(tmp_path / "in"))
    lake = Lake(spark, str(tmp_path / "lake"))
    q = live.ingest_stream(stream, lake, lambda df: shot(spark), str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert lake.samples().count() == 40


def test_ingest_stream_keeps_channels_that_span_batches(spark, tmp_path):
    """One channel in two files, one file per micro-batch; then the first file again."""
    for k, (lo, hi) in enumerate([(0, 20), (20, 40), (0, 20)]):
        spark.createDataFrame([(7, "a", i, float(i), float(i)) for i in range(lo, hi)], "shot long, channel string, i long, t_ms double, value double") \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("shot long, channel string, i long, t_ms double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    lake = Lake(spark, str(tmp_path / "lake"))
    q = live.ingest_stream(stream, lake, lambda df: shot(spark), str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.i for r in lake.samples().collect()) == list(range(40))
    assert lake.channels().first().n == 40


FEED = "shot long, channel string, i long, t_ms double, value double"


def feed_files(spark, path, spans):
    for k, (lo, hi) in enumerate(spans):
        spark.createDataFrame([(7, "a", i, float(i), float(i)) for i in range(lo, hi)], FEED).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_ingest_stream_takes_files_in_any_order(spark, tmp_path):
    stream = feed_files(spark, str(tmp_path / "in"), [(20, 40), (0, 20), (60, 70), (30, 62)])
    lake = Lake(spark, str(tmp_path / "lake"))
    q = live.ingest_stream(stream, lake, lambda df: shot(spark), str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.i, r.t_ms, r.value) for r in lake.samples().collect()) == [(i, float(i), float(i)) for i in range(70)]
    assert lake.channels().first().n == 70


def test_time_bases_are_stored_once(spark, tmp_path):
    """Equal vectors are shared; vectors with equal ends and length are not; times come back exactly."""
    n = 40000  # several blocks
    even = np.arange(n) * 0.1
    bent = even.copy()
    bent[1:-1] += 1e-3
    times = {"a": even, "b": even, "c": bent, "d": even}
    pdf = pd.concat([pd.DataFrame({"shot": 7, "channel": c, "i": np.arange(n), "t_ms": t, "value": np.arange(n) * 1.0}) for c, t in times.items()])
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.ingest(0, spark.createDataFrame(pdf), shot(spark))
    assert lake.time_report().select("channels", "bases", "time_bytes", "saved_bytes").first() == (4, 2, 16 * n, 16 * n)
    for c, t in times.items():
        assert np.array_equal(lake.load_channel(7, c).orderBy("i").toPandas()["t_ms"].to_numpy(), t)
    assert lake.samples().count() == 4 * n and lake.load_data(7, "b").count() == n


def test_windows_with_gaps_are_flagged(spark, tmp_path):
    pdf = write_feed(spark, str(tmp_path / "whole"))
    pdf = pdf[pdf.channel == "p1"]
    lost = pd.concat([pdf[(pdf.i != 70) & (pdf.i != 71)], pdf[pdf.i == 72]])  # two samples lost, one told twice
    spark.createDataFrame(lost).coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("shot long, channel string, i long, ts timestamp, value double").parquet(str(tmp_path / "feed"))
    spec = drain(live.sliding_spectra(stream, n_fft=64, rate=1000.0, ks=[8], late="10 milliseconds"), "gaps").sort_values("start")
    begin = ((spec.start - pd.Timestamp("2024-01-01")) / pd.Timedelta(1, "ms")).round().astype(int)
    assert begin.is_unique
    x, w = pdf.value.to_numpy(), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    for b, r in zip(begin, spec.itertuples()):
        whole = b >= 0 and b + 64 <= 256 and not b <= 72 < b + 64
        assert r.complete == whole and (whole or np.isnan(r.re))
        if whole:
            v = x[b : b + 64]
            assert np.isclose(r.re + 1j * r.im, np.fft.rfft((v - v.mean()) * w)[8]) and r.n_samples == 64
    assert spec.complete.sum() >= 3 and (~spec.complete).sum() >= 2


def test_causal_filter_takes_rows_in_any_order(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=400)
    order = [(100, 200), (0, 50), (50, 100), (300, 400), (150, 250), (250, 300)]
    for k, (lo, hi) in enumerate(order):
        spark.createDataFrame(pd.DataFrame({"shot": 1, "channel": "p", "i": np.arange(lo, hi)[::-1], "value": v[lo:hi][::-1]})) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("shot long, channel string, i long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    taps = condition.causal_taps(5.0)
    got = drain(live.causal_filter(stream, 5.0), "ordered").sort_values("i")
    want = np.correlate(np.concatenate([np.full(len(taps) - 1, v[0]), v]), taps, mode="valid")
    assert list(got.i) == list(range(400)) and np.allclose(got.value, want) and not got.after_gap.any()


def test_causal_filter_goes_on_behind_a_gap(spark, tmp_path):
    stream = feed_files(spark, str(tmp_path / "in"), [(0, 20), (30, 60), (22, 25)]).select("shot", "channel", "i", "value")
    got = drain(live.causal_filter(stream, 1.0, reorder=10), "gap").sort_values("i")
    assert list(got.i) == [*range(20), *range(30, 60)]
    assert list(got.i[got.after_gap]) == [30, 31, 32, 33] and got.value[got.i == 30].iloc[0] == 30.0


def test_idle_channel_gives_out_what_waits(spark, tmp_path):
    stream = feed_files(spark, str(tmp_path / "in"), [(0, 20), (30, 40)]).select("shot", "channel", "i", "value")
    q = live.causal_filter(stream, 1.0, idle="1 second").writeStream.format("memory").queryName("idle").start()
    try:
        for _ in range(60):
            if spark.table("idle").count() == 30:
                break
            time.sleep(1)
        assert sorted(r.i for r in spark.table("idle").collect()) == [*range(20), *range(30, 40)]
    finally:
        q.stop()


def test_mismatched_and_lone_samples(spark):
    rows = [(1, "a", 0, 0.0, 1.0), (1, "a", 1, 1.0, None), (1, "b", 0, 0.0, 0.0), (1, "c", 0, 0.0, 0.5)]
    got = {r.channel: r.status for r in channel_status(spark.createDataFrame(rows, "shot long, channel string, i long, t_ms double, value double")).collect()}
    assert got == {"a": "missing", "b": "missing", "c": "fetched"}
