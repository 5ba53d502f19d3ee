"""Every product on fabricated recordings with known modes."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ringwave.operators import spectra
from ringwave.plans import products
from ringwave.session import cut_lineage
from synthetic import archive


@pytest.fixture(scope="module")
def arch(spark):
    a = archive(spark, (990000, 990002))
    a.samples, a.sensors = cut_lineage(a.samples), cut_lineage(a.sensors)
    a.arrays = {k: cut_lineage(v) for k, v in a.arrays.items()}
    return a


def test_spectrogram_peaks_and_gate(arch):
    p = products.spectrogram(arch).toPandas()
    one = p[p.shot == 990000]
    mean = one.groupby("f_khz").z.apply(lambda z: np.mean(10**z))
    assert abs(mean.idxmax() - 5.0) <= 1.0
    assert set(p.shot) == {990000, 990002}
    assert len(one) * 2 == len(p)
    g = products.spectrogram(arch, denoise=True, coherence_min=0.5, power_floor_k=1.0, fmax=10.0).toPandas()
    assert g.z.isna().any() and g.f_khz.max() <= 10.0


def test_coherence_bounds_and_n_spectrum(arch):
    c = products.coherence(arch).toPandas()
    assert c.z.between(0, 1).all()
    n = products.n_spectrum(arch).toPandas()
    assert (n.rms >= 0).all() and n.groupby(["shot", "frame"]).size().nunique() == 1


def test_mode_number_map(arch):
    m = products.mode_number(arch).toPandas()
    assert (m.method == "array").all()
    assert m.quality.between(1 / 11 - 1e-9, 1 + 1e-9).all()
    near5, near8 = m[(abs(m.f_khz - 5) < 0.3) & m.z.notna()], m[(abs(m.f_khz - 8) < 0.3) & m.z.notna()]
    assert (near5.z == 1).mean() > 0.9 and (near8.z == 2).mean() > 0.9


def test_mode_number_falls_back_to_the_pair(arch):
    few = arch.samples.where(F.col("channel").isin("MPI66M020D", "MPI66M067D"))
    m = products.mode_number(products.Archive(few, arch.sensors, arch.arrays)).toPandas()
    assert len(m) and (m.method == "pair").all()


@pytest.mark.parametrize("f_khz,n", [(5.0, 1), (8.0, 2)])
def test_phase_fit_recovers_n(arch, f_khz, n):
    d = products.phase_fit(arch, f_khz=f_khz, time=50.0).toPandas()
    assert set(d.n.abs()) == {n}
    assert (d.resultant > 0.95).all() and (d.n_confidence > 0.9).all()
    assert d.groupby("shot").phase_error.apply(lambda s: s.isna().sum()).eq(1).all()


def test_auto_frequency_follows_the_strongest_mode(arch):
    assert set(products.auto_frequency(arch).toPandas().f_khz) == {5.0}


def test_poloidal_fit_and_pattern(arch):
    d = products.poloidal_phase_fit(arch, f_khz=5.0, time=50.0).toPandas()
    assert len(d) and np.isfinite(d.phase).all()
    p = products.mode_pattern(arch, f_khz=5.0, time=50.0).toPandas()
    assert len(p) == 2 * 181 * 181 and np.isfinite(p.z).all()
    s = products.mode_shape(arch, f_khz=8.0, time=50.0).toPandas()
    one = s[s.shot == 990000].sort_values("grid_deg")
    spec = np.abs(np.fft.fft(one.re_mean + 1j * one.im_mean))
    assert min(np.argmax(spec), 181 - np.argmax(spec)) == 2


def test_tracks(arch):
    t = products.mode_track(arch, f_khz=5.0, n_slices=20).toPandas()
    assert set(t.dominant_n.abs()) == {1} and t.mac.between(0, 1 + 1e-9).all() and (t.mac > 0.9).mean() > 0.9
    r = products.mode_over_time(arch, n_slices=20).toPandas()
    assert set(r.dominant_n.abs()) == {1} and (abs(r.f_khz - 5) <= 1).mean() > 0.9


def test_raw_views(arch):
    c = products.contour(arch, columns=40).toPandas()
    assert len(c) == 2 * 40 * 73 and np.isfinite(c.z).all()
    s = products.toroidal_stripes(arch, f_khz=5.0, time=50.0).toPandas()
    assert s.angle.nunique() == 120 and len(s)
    off = products.toroidal_stripes(arch, f_khz=5.0, time=1e6).toPandas()
    assert off.groupby("shot").t_ms.nunique().eq(320).all()
    assert len(products.poloidal_stripes(arch, f_khz=5.0, time=50.0).toPandas())
    r = products.raw_trace(arch, time=50.0).toPandas()
    assert r.t_ms.between(48, 52).all() and r.channel.nunique() == 1


def test_geometry_views(arch):
    assert len(products.geometry(arch).toPandas()) == 2 * 40
    assert len(products.sensor_map_rz(arch).toPandas()) and len(products.sensor_map_cylindrical(arch).toPandas())
    u = products.channel_usage(arch).toPandas()
    assert u.used.any() and (~u.used).any()
    assert (products.fit_quality_geometry(arch).toPandas().quality == "good").all()


def test_single_time_spectrum(arch):
    d = products.single_time_spectrum(arch, time=50.0, power_pct=90.0).toPandas()
    kept = d[d.n > 0]
    assert set(kept.n) <= {1.0, 2.0} and len(kept)


def test_levels_share_the_frequency_axis(arch):
    d = products.spectrogram_levels(arch, (20, 100)).groupBy("level", "final").agg(F.count_distinct("frame").alias("c"), F.count_distinct("f_khz").alias("f")).toPandas()
    d = d.sort_values("level")
    assert d.f.nunique() == 1 and d.c.is_monotonic_increasing and list(d.final) == [False, True]


def test_shot_batch_equals_single_shot(arch):
    both = products.phase_fit(arch, f_khz=5.0, time=50.0).where("shot = 990002").toPandas().sort_values("channel")
    one = products.Archive(arch.samples.where("shot = 990002"), arch.sensors, arch.arrays)
    alone = products.phase_fit(one, f_khz=5.0, time=50.0).toPandas().sort_values("channel")
    assert np.allclose(both.phase, alone.phase)


def test_unknown_product(arch):
    with pytest.raises(KeyError):
        products.build(arch, "nothing")


# ---- quasi-stationary chain -----------------------------------------------------------------
QS = dict(t_lo=0.0, t_hi=0.0999, cutoff=(0.0, 20e3), detrend="none", energy=1.0, ns=(1, 2, 3))


@pytest.fixture(scope="module")
def qs(arch):
    keep = arch.sensors.where((F.col("family") == "MPID") & ((F.col("theta") < 20) | (F.col("theta") > 340)))
    a = products.Archive(arch.samples.join(keep.select("shot", "channel"), ["shot", "channel"], "left_semi"), keep, arch.arrays)
    return a


def test_amplitude_ratio(qs):
    d = products.amplitude(qs, **QS).toPandas()
    a = d.groupby("n").amplitude.median()
    assert abs((a[1.0] / a[2.0]) / (1.0 / 0.6) - 1) < 0.2
    assert a[3.0] < 0.1 * a[2.0]


def test_qs_products(qs):
    q = products.fit_quality(qs, **QS).toPandas()
    assert (q.raw_quality == "good").all() and (q.modes == 3).all()
    m = products.qs_fit(qs, **QS).toPandas()
    assert len(m) == 2 * 73 * 49 and set(m.dominant_n) <= {1.0, 2.0}
    assert len(products.phi_t(qs, **QS).toPandas()) and products.phase_t(qs, **QS).toPandas().visible.any()
    chi = products.chi_sq_t(qs, **QS).toPandas()
    assert (chi.red_chi_sq >= 0).all()
    s = products.fit_signals(qs, **QS).toPandas()
    assert np.corrcoef(s.signal, s.fit)[0, 1] > 0.99
    r = products.fit_residuals(qs, **QS).toPandas()
    assert r[r.worst].groupby("shot").channel.nunique().eq(6).all()
    c = products.signal_conditioning(qs, **QS).toPandas().sort_values("t_ms")
    first = c.groupby(["shot", "channel"]).first()
    assert np.allclose(first.prepared, first.raw, atol=1e-6)
    e = products.svd_diagnostics(qs, **QS).toPandas()
    assert np.isclose(e.groupby("shot").energy_fraction.max(), 1).all()
