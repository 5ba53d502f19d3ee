"""Brute-force checks of the queries that have no SQL, and edge cases."""
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringwave.functions import scalar, tables
from ringwave.operators import blocks, catalog, condition, modes, resample, shape, spatial, spectra
from ringwave.sources.signal_catalog import decimate_allowed
from workload import mode_queries

RNG = np.random.default_rng(3)


def frame(spark, values, shot=1, channel="a", dt=1e-3):
    n = len(values)
    return spark.createDataFrame(pd.DataFrame({"shot": shot, "channel": channel, "i": np.arange(n), "t_s": np.arange(n) * dt, "value": values}))


def fourier_resample(x, m):
    n, keep = len(x), min(len(x), m)
    spec, half = np.fft.rfft(x), np.zeros(m // 2 + 1, complex)
    half[: keep // 2 + 1] = spec[: keep // 2 + 1]
    if keep % 2 == 0 and m != n:
        half[keep // 2] *= 2 if m < n else 0.5
    return np.fft.irfft(half, m) * m / n


@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_resample_direct_and_split(spark, limit):
    x = RNG.standard_normal(211)  # a prime length
    got = resample.resample(frame(spark, x), 400.0, direct_limit=limit).toPandas().sort_values("i")
    m = int(np.floor(210 * 1e-3 * 400.0))
    assert len(got) == m and np.allclose(got.value, fourier_resample(x, m), atol=1e-9)


def test_short_record_gives_one_padded_frame(spark):
    x = RNG.standard_normal(10)
    got = spectra.stft(frame(spark, x), 16, 8).toPandas().sort_values("k")
    pad = np.zeros(16)
    pad[:10] = x - x.mean()
    ref = np.fft.rfft(pad * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)))
    assert set(got.frame) == {0} and np.allclose(got.re + 1j * got.im, ref)


def test_svd_condition_matches_dense_svd(spark):
    p, t = 5, 400
    base = np.outer(RNG.standard_normal(p), np.sin(np.arange(t) / 7)) * 5 + np.outer(RNG.standard_normal(p), np.cos(np.arange(t) / 5)) * 3
    m = base + 0.1 * RNG.standard_normal((p, t))
    pdf = pd.concat([pd.DataFrame({"shot": 1, "channel": f"c{j}", "i": np.arange(t), "t_s": np.arange(t) * 1e-3, "value": m[j]}) for j in range(p)])
    clean, basis = condition.svd_condition(spark.createDataFrame(pdf), 0.98)
    got = clean.toPandas().sort_values(["channel", "i"]).value.to_numpy().reshape(p, t)
    u, s, vh = np.linalg.svd(m, full_matrices=False)
    cut = condition.energy_cut(s / np.sqrt(p * t), 0.98, p)
    assert np.allclose(got, (u[:, :cut] * s[:cut]) @ vh[:cut], atol=1e-8)
    assert basis.first()["rank"] == cut


def test_condition_number_rules(spark):
    rows = [(1, float(a)) for a in np.arange(8) * 45] + [(2, float(a)) for a in range(5)] + [(3, float(a)) for a in range(8)]
    k = spatial.condition_number(spark.createDataFrame(rows, "shot long, phi double"), 3).toPandas().set_index("shot")
    assert k.k[1] == pytest.approx(np.sqrt(2), rel=1e-6) and np.isinf(k.k[2]) and k.quality[3] == "bad"


def test_rectangular_fit_matches_lstsq(spark):
    phi = np.sort(RNG.uniform(0, 360, 12))
    s = spark.createDataFrame(pd.DataFrame({"shot": 1, "channel": [f"s{j:02d}" for j in range(12)], "phi_end1": phi - 1, "phi_end2": phi + 1, "theta_end1": -1.0, "theta_end2": 1.0, "sigma": 1.0}))
    inv = spatial.invert_design(spatial.basis_rows(s, ns=(1, 2), basis="sinusoidal-point"), fit_cond=1e6)
    v = RNG.standard_normal(12)
    x = spark.createDataFrame(pd.DataFrame({"shot": 1, "channel": [f"s{j:02d}" for j in range(12)], "i": 0, "t_s": 0.0, "value": v}))
    got = spatial.fit_coefficients(x, inv, 2).first()["coef"]
    r = np.deg2rad(phi)
    ref = np.linalg.lstsq(np.column_stack([np.cos(r), np.sin(r), np.cos(2 * r), np.sin(2 * r)]), v, rcond=None)[0]
    assert np.allclose(got, ref)


def test_helicity_and_mode_order():
    assert spatial.mode_list((1, 2), (1,), -1) == [(1, -1), (2, -1)]
    assert spatial.mode_list((1, 0), (0,), -1)[0] == (0, 0)


def test_gp_band_covers_a_held_out_probe(spark):
    phi = np.arange(16) * 22.5
    pdf = pd.DataFrame({"s": 1, "phi": phi, "re": 1e5 * np.cos(2 * np.deg2rad(phi)), "im": 1e5 * np.sin(2 * np.deg2rad(phi)), "noise": 3e3})
    g = shape.gp_mode_shape(spark.createDataFrame(pdf.drop(index=5)), ["s"]).toPandas()
    at = g.iloc[(g.grid_deg - phi[5]).abs().argmin()]
    assert abs(at.re_mean - pdf.re[5]) < 3 * at.re_sigma + 2e4
    assert np.max(np.abs(g.re_mean)) == pytest.approx(1e5, rel=0.2)


def test_zero_vector_and_uniform_weights(spark):
    d = spark.createDataFrame([(1, float(a), 0.0, 0.0) for a in range(0, 360, 45)], "s int, phi double, re double, im double")
    assert modes.mac_templates(d, ["s"]).first()["best_mac"] == 0.0
    m = spark.createDataFrame([(1, float(a), float(-2 * a % 360), 0.0) for a in range(0, 360, 30)], "s int, phi double, phase double, amplitude double")
    assert modes.circular_fit(m, ["s"]).first()["n"] == 2
    with pytest.raises(ValueError):
        modes.circular_fit(m, ["s"], (3, 1))


def test_zero_separation_raises(spark):
    d = spark.createDataFrame([(10.0, 0.0)], "phase double, delta_phi double")
    with pytest.raises(Exception, match="non-zero"):
        spectra.with_mode_number(d).collect()


def test_gates_never_add_power(spark):
    pdf = pd.DataFrame({"shot": 1, "frame": np.repeat(np.arange(50), 8), "k": np.tile(np.arange(8), 50), "power": RNG.random(400), "coherence": RNG.random(400)})
    d = spark.createDataFrame(pdf)
    off = spectra.denoise(d, coherence_min=0.0, power_floor_k=None).toPandas().sort_values(["frame", "k"])
    on = spectra.denoise(d, coherence_min=0.5).toPandas().sort_values(["frame", "k"])
    assert np.array_equal(off.power, pdf.power) and (on.power.to_numpy() <= pdf.power.to_numpy()).all()
    assert spectra.smooth_spectrogram(d, sigma_time_bins=0, sigma_freq_bins=0) is d


def test_percentile_on_a_large_skewed_group(spark):
    v = np.concatenate([RNG.standard_normal(30000), np.zeros(20000)])
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "v": v}))
    for p in (0.0, 0.37, 0.5, 0.999, 1.0):
        assert blocks.exact_percentile(d, ["k"], "v", p, "q", 1000).first()["q"] == pytest.approx(np.percentile(v, 100 * p), abs=1e-12)


def test_unknown_analysis():
    assert decimate_allowed("quasi-stationary") and not decimate_allowed("rotating")
    with pytest.raises(ValueError):
        decimate_allowed("other")


def test_integral_of_a_cosine(spark):
    t = np.arange(5000) / 50e3
    d = frame(spark, np.cos(2 * np.pi * 500 * t) * 2 * np.pi * 500 + 100.0, dt=1 / 50e3)
    got = condition.integrate(d).toPandas().sort_values("i").value
    assert np.corrcoef(got, np.sin(2 * np.pi * 500 * t))[0, 1] > 0.999


def test_sql_functions_and_set_arrays(spark):
    from ringwave.functions.scalar import register_sql_functions
    from ringwave.plans.arrays import by_set

    register_sql_functions(spark)
    row = spark.sql("SELECT wrap180(190D), wrap360(-10D), delta_degrees(350D, 10D), theta_star(45D, 1D)").first()
    assert row[0] == -170.0 and row[1] == 350.0 and row[2] == 20.0 and row[3] == pytest.approx(45.0)
    sensors = spark.createDataFrame([(1, "d", f"s{j}", 30.0 * j, 0.0) for j in range(6)], "shot long, device_id string, channel string, phi double, theta double")
    flat = spark.createDataFrame([("d", "HF toroidal array", f"s{j}", [j]) for j in range(4)] + [("d", "HN toroidal array", f"s{j}", [j]) for j in range(2, 6)],
                                 "device_id string, set_name string, member string, path array<int>")
    got = by_set(sensors, flat, "toroidal").groupBy("pref").count().orderBy("pref").collect()
    assert [r["count"] for r in got] == [4, 4, 6]  # shared probes stay in both sets


# ---- sets and frames ---------------------------------------------------------------------
SETS = "device_id string, set_name string, type string, member string, ord int"


def layered(levels, width=2):
    """Every set of a level holds all sets of the next: width ** levels paths."""
    rows = [("d", f"s{k}.{a}", "composite", f"s{k + 1}.{b}", b) for k in range(levels) for a in range(width) for b in range(width)]
    return rows + [("d", f"s{levels}.{a}", "list", f"m{a}", 0) for a in range(width)]


def test_closure_of_many_paths_is_linear_in_pairs(spark):
    levels = 20
    sets = spark.createDataFrame(layered(levels), SETS)
    flat = catalog.flatten_sets(spark, sets)
    assert flat.count() == 2 * (2 * levels + 1)
    least = flat.where("set_name = 's0.1'").orderBy("member").collect()
    assert [list(r.path) for r in least] == [[0] * levels + [0], [0] * (levels - 1) + [1, 0]]


def test_closure_takes_the_least_path_not_the_shortest(spark):
    rows = [("d", "r", "composite", "a", 0), ("d", "r", "composite", "b", 1), ("d", "a", "composite", "b", 0), ("d", "b", "list", "x", 3), ("d", "b", "composite", "a", 1)]
    flat = {(r.set_name, r.member): list(r.path) for r in catalog.flatten_sets(spark, spark.createDataFrame(rows, SETS)).collect()}
    assert flat[("r", "x")] == [0, 0, 3] and flat[("a", "x")] == [0, 3] and flat[("b", "x")] == [3]


@pytest.mark.parametrize("row,word", [(("d", "r", "composite", "none", 0), "unknown sensor set none"), (("d", "r", "odd", "x", 0), "unknown type odd"),
                                      (("d", "r", "composite", "r", 0), "holds itself")])
def test_strict_sets(spark, row, word):
    sets = spark.createDataFrame([row, ("d", "l", "list", "x", 0)], SETS)
    catalog.flatten_sets(spark, sets).count()
    with pytest.raises(ValueError, match=word):
        catalog.flatten_sets(spark, sets, strict=True)


@pytest.mark.parametrize("n_fft,hop", [(8, 4), (5, 2), (4, 6)])
def test_frames_of_sql(spark, n_fft, hop):
    x = np.arange(100) * 1.5
    there = [i for i in range(100) if i not in (41, 42)]
    rows = [(1, c, i, float(x[i])) for c in "ab" for i in there] + [(1, "a", 7, -1.0)]
    samples = spark.createDataFrame(rows, "shot long, channel string, i long, value double").where("not (channel = 'a' and i = 7 and value < 0)")
    tables.register_table_functions(spark)
    parts = tables.framing_parts(samples, n_fft, hop, frames=3)
    found = spark.sql(f"select * from frames(table(select * from {{p}}) partition by (shot, channel, part) order by (i), {n_fft}, {hop})", p=parts).collect()
    want = [(1, c, f, list(x[f * hop : f * hop + n_fft])) for c in "ab" for f in range((100 - n_fft) // hop + 1)
            if not any(f * hop <= i < f * hop + n_fft for i in (41, 42))]
    assert sorted((r.shot, r.channel, r.frame, list(r.samples)) for r in found) == want


def test_percentiles_of_a_key_with_nearly_all_rows(spark):
    """Ties, a cluster inside the bracket, infinities, and keys of one row, in one call for several ranks."""
    rng = np.random.default_rng(5)
    big = np.concatenate([rng.normal(size=30000), np.full(9000, 0.25), 0.25 + 1e-9 * rng.random(9000), [np.inf, -np.inf]])
    other = {1: rng.normal(size=700), 2: np.array([3.0]), 3: np.array([1.0, 2.0]), 4: np.full(6000, 7.0)}
    rows = pd.concat([pd.DataFrame({"k": 0, "v": big}), *(pd.DataFrame({"k": k, "v": v}) for k, v in other.items()), pd.DataFrame({"k": [5, 1], "v": [np.nan, np.nan]})])
    wanted = {"q0": 0.0, "q1": 0.371, "q2": 0.6, "q3": 0.97, "q4": 1.0}
    found = {r.k: r for r in blocks.exact_percentiles(spark.createDataFrame(rows), ["k"], "v", wanted, accuracy=1000).collect()}
    assert set(found) == {0, *other}
    for k, v in {0: big, **other}.items():
        for name, p in wanted.items():
            at = p * (len(v) - 1)
            low, high = np.sort(v)[[int(np.floor(at)), int(np.ceil(at))]]
            assert found[k][name] == pytest.approx(low if low == high else low + (high - low) * (at % 1), abs=1e-12)


@pytest.mark.parametrize("ns,phis", [((1, 2), [0, 40, 95, 160, 215, 290, 330]), ((1, 7), [0, 60, 120, 180, 240, 300]), ((1, 2, 3), [0, 10, 200, 210])])
def test_chi_square_without_samples(spark, ns, phis):
    """Coefficients and the products of the design give what the residuals give, also where columns depend on each other."""
    phi = [float(p) for p in phis]
    sensors = spark.createDataFrame([(1, f"p{j}", p, p - 1, p + 1, -1.0, 1.0, 0.5 + 0.1 * j) for j, p in enumerate(phi)],
                                    "shot long, channel string, phi double, phi_end1 double, phi_end2 double, theta_end1 double, theta_end2 double, sigma double")
    values = RNG.normal(size=(40, len(phi)))
    samples = spark.createDataFrame([(1, f"p{j}", i, i * 0.1, float(values[i, j])) for i in range(40) for j in range(len(phi))],
                                    "shot long, channel string, i long, t_s double, value double")
    inverse = spatial.invert_design(spatial.basis_rows(sensors, ns=ns, basis="sinusoidal-point"))
    coef = spatial.fit_coefficients(samples, inverse, len(ns))
    told = {r.i: r for r in spatial.chi_square(coef, inverse, len(ns)).collect()}
    seen = spatial.fitted_signal(samples, coef, inverse, len(ns)).groupBy("i").agg(F.sum((F.col("residual") / F.col("sigma")) ** 2).alias("c")).collect()
    rank = inverse.first()["rank"]
    for r in seen:
        assert told[r.i].chi_sq == pytest.approx(r.c, abs=1e-9)
        assert told[r.i].red_chi_sq == pytest.approx(r.c / max(1, len(phi) - rank), abs=1e-9)


def test_stacked_shape_fits_equal_single_ones(spark):
    rng, rows = np.random.default_rng(5), []
    for g in range(150):  # more than a stack, of different sizes
        n = 5 + g % 4
        rows += [(g, float(a), *rng.normal(size=2).tolist(), 0.1 + 0.01 * g) for a in rng.uniform(0, 360, n)]
    rows += [(150, 10.0 * j, 1.0, 0.5, 0.0) for j in range(8)]  # without noise: long scales are not positive definite
    d = spark.createDataFrame(rows, "g long, phi double, re double, im double, noise double")
    got = dict(list(shape.gp_mode_shape(d, ["g"]).toPandas().sort_values(["g", "grid_deg"]).groupby("g")))
    pdf, grid = d.toPandas().sort_values(["g", "phi"]), np.linspace(0.0, 2 * np.pi, 181, endpoint=False)
    assert len(got) == 151
    for g, one in pdf.groupby("g"):
        phi, scale = np.deg2rad(one.phi.to_numpy()), np.sqrt(np.mean(one.re**2 + one.im**2))
        cols, var = [one.re.to_numpy() / scale, one.im.to_numpy() / scale], (one.noise.to_numpy() / scale) ** 2
        length = shape.choose_length(phi, cols, var)
        assert np.allclose(got[g].length_scale, length, rtol=1e-9)
        for name, c in zip(("re", "im"), cols):
            mean, sig = shape.posterior(phi, c, grid, length, var)
            assert np.allclose(got[g][f"{name}_mean"], mean * scale, atol=1e-6) and np.allclose(got[g][f"{name}_sigma"], sig * scale, atol=1e-6)


def test_pattern_fits_each_shape_once_and_equals_the_product_of_shapes(spark):
    rng = np.random.default_rng(7)
    tor, pol = (spark.createDataFrame([(g, 45.0 * j, *rng.normal(size=2).tolist(), 0.1) for g in keys for j in range(8)],
                                      "g long, phi double, re double, im double, noise double") for keys in ((1, 2), (2, 3)))
    got = shape.gp_pattern(tor, pol, ["g"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("Exchange") == 1
    want = shape.pattern(shape.gp_mode_shape(tor, ["g"]), shape.gp_mode_shape(pol, ["g"]), ["g"])
    a, b = (d.toPandas().sort_values(["g", "phi", "theta"]).reset_index(drop=True) for d in (got, want))
    assert len(a) == 181 * 181 and np.allclose(a, b, atol=1e-9)


def test_pattern_bounds_a_task_and_begins_with_small_maps(spark, tmp_path):
    rng = np.random.default_rng(8)
    tor, pol = (spark.createDataFrame([(g, 45.0 * j, *(rng.normal(size=2) * 10.0 ** (g * 5 % 7)).tolist(), 0.1) for g in range(40) for j in range(8)],
                                      "g long, phi double, re double, im double, noise double") for _ in range(2))
    got = shape.gp_pattern(tor, pol, ["g"]).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    order = got.groupBy("part", "g").agg(F.min("at").alias("at"), F.count("z").alias("n")).toPandas().sort_values("at")
    assert len(order) == 40 and (order.n == 181 * 181).all()
    assert order.groupby("part").size().max() > 1
    for _, one in order.groupby("part"):
        assert (one.g * 5 % 7).is_monotonic_increasing

    n = 2000
    vectors = rng.normal(size=(n, 64)) / 8
    pd.DataFrame({"vec_id": np.arange(n), "label": 0, "embedding": list(vectors.astype("float32"))}).to_parquet(tmp_path / "embeddings.parquet")
    plan = mode_queries.mode_pattern(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.count("Exchange") == 1
    assert re.search(rf"hashpartitioning\(vec_id#\d+L?, {-(-n // shape.MAPS)}\), REPARTITION_BY_NUM", plan)  # the session's shuffles have 8


def test_round_to_equals_round(spark):
    rng = np.random.default_rng(6)
    xs = [0.0, -0.0, 2.5e-6, -0.5e-6, 1.0000005, -3.0000015, 1e300, -1e15, 1234567.1234565, float("nan"), float("inf"), None]
    xs += (rng.integers(-10**9, 10**9, 500) / 2e6).tolist() + (rng.normal(size=2000) * 10.0 ** rng.integers(-8, 9, 2000)).tolist()
    d = spark.createDataFrame([(x,) for x in xs], "x double").select(scalar.round_to("x", 6).alias("a"), F.round("x", 6).alias("b"))
    assert d.where("not (a <=> b)").count() == 0


def test_python_runs_once_a_block_and_hands_back_pieces(spark):
    n = 3 * blocks.BLOCK + 100
    x = RNG.standard_normal(n)
    d = spark.createDataFrame(pd.DataFrame({"shot": 1, "channel": "a", "i": np.arange(n), "value": x})).coalesce(1)
    spec = spectra.stft_frames(d, 64, 32)
    box = blocks.filtered(d, ["shot", "channel"], "i", {"y": "value"}, lambda q: np.full(3, 1 / 3), "reflect", before=1, after=1)
    for made in (spec, box):
        made.collect()
        assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = spec.toPandas().sort_values("frame")
    frames = np.lib.stride_tricks.sliding_window_view(x, 64)[::32]
    want = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)), axis=1)
    assert got.frame.tolist() == list(range(len(frames)))
    assert np.allclose(np.stack(got.re) + 1j * np.stack(got.im), want, atol=1e-9)
    assert np.allclose(box.toPandas().sort_values("i").y, np.convolve(np.pad(x, 1, mode="symmetric"), np.full(3, 1 / 3), "valid"))


def test_mode_map_deals_out_cells_not_sums(spark):
    rows = [(1, f"p{c}", f, k, float(np.cos(c + k)), float(np.sin(c + k))) for c in range(7) for f in range(3) for k in range(4)]
    d = spark.createDataFrame(rows, "shot long, channel string, frame long, k int, re double, im double")
    angles = spark.createDataFrame([(f"p{c}", c * 360 / 7) for c in range(7)], "channel string, phi double")
    m = modes.mode_map(d, angles, 3)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_sum") < plan.index("Exchange hashpartitioning")  # the plan is listed from its end
    assert m.count() == 12


def test_one_frequency_transforms_the_probes_once(spark):
    n, t = 900, np.arange(900) * 1e-3
    d = frame(spark, np.sin(2 * np.pi * 125 * t), channel="a").unionByName(frame(spark, 2 * np.sin(2 * np.pi * 125 * t - 1.0), channel="b"))
    angles = spark.createDataFrame([("a", 0.0), ("b", 90.0)], "channel string, phi double")
    cursors = spark.createDataFrame([(1, 0, None, 0.3995, 125.0, 64), (1, 1, 0.4, None, None, 64)], "shot long, cursor long, t_lo double, t_hi double, f_hz double, nperseg long")
    made = modes.mode_from_signals(d, angles, cursors, spark.createDataFrame([(1, "a")], "shot long, ref string"), 1000.0)
    rows = {(r.cursor, r.channel): r for r in made.collect()}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 0  # its four readers find the spectra written
    assert len(rows) == 4 and all(r.f_hz == 125.0 and r.k == 8 for r in rows.values())
    for cursor, size in ((0, 400), (1, 500)):
        b = rows[cursor, "b"]
        assert b.n_segments == (size - 64) // 32 + 1 and np.isclose(b.coherence, 1) and np.isclose(b.phase, np.degrees(1.0))
        assert np.isclose(b.amplitude, 2 * rows[cursor, "a"].amplitude)
