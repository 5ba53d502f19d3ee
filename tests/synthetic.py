"""Fabricated recordings with known modes."""
from __future__ import annotations

import numpy as np
import pandas as pd

from ringwave.functions import scalar as X
from ringwave.plans.arrays import default_arrays
from ringwave.plans.products import Archive
from ringwave.sources.signal_catalog import SIGNAL_GROUPS

FS, DURATION = 50e3, 0.1
MODES = ((1, 1, 5e3, 1.0), (2, 0, 8e3, 0.6))  # n, m, frequency, amplitude


def wave(phi, theta, seed, modes=MODES, noise=0.02):
    t = np.arange(int(FS * DURATION)) / FS
    rng = np.random.default_rng(seed)
    v = noise * rng.standard_normal(len(t))
    for n, m, f, a in modes:
        v += a * np.sin(2 * np.pi * f * t - n * np.deg2rad(phi) - m * np.deg2rad(theta))
    return t, v


def probes():
    """(channel, family, phi, theta): derivative probes, integrated midplane and off-midplane probes."""
    out = []
    for c in SIGNAL_GROUPS["MPI_BDOT"]:
        out.append((c, "MPI_BDOT", float(c[6:9]), 0.0))
    for c in SIGNAL_GROUPS["MPID"][:10]:
        out.append((c, "MPID", float(c[-3:]), 0.0))
    for j, c in enumerate(SIGNAL_GROUPS["MPID"][10:26]):
        out.append((c, "MPID", float(c[-3:]), 30.0 + 300.0 * j / 15))
    return out


def archive(spark, shots=(990000,), with_kappa=True, amplitude=1.0) -> Archive:
    rows, geo = [], []
    for shot in shots:
        for c, fam, phi, theta in probes():
            t, v = wave(phi, theta, round(phi) * 1000 + round(theta))
            rows.append(pd.DataFrame({"shot": shot, "channel": c, "i": np.arange(len(t)), "t_ms": t * 1e3, "value": amplitude * v}))
            r0, a = 1.69, 0.7
            geo.append((shot, c, "d", fam, X.FAMILY_KIND[fam], phi, theta, float(r0 + a * np.cos(np.deg2rad(theta))), float(a * np.sin(np.deg2rad(theta))), 0.1, 90.0, 2.0))
        if with_kappa:
            t = np.arange(20) * 5.0
            rows.append(pd.DataFrame({"shot": shot, "channel": "kappa", "i": np.arange(20), "t_ms": t, "value": 1.8}))
    samples = spark.createDataFrame(pd.concat(rows))
    sensors = spark.createDataFrame(geo, "shot long, channel string, device_id string, family string, kind string, phi double, theta double, r double, z double, "
                                         "length double, tilt double, delta_phi double")
    sensors = sensors.withColumns(X.endpoint_columns(1.69)).withColumn("shape", X.sensor_shape("delta_phi"))
    return Archive(samples, sensors, default_arrays(sensors))
