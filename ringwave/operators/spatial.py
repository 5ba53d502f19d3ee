"""Least-squares spatial fits: bases, small per-recording inversions and the distributed application."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringwave.functions.scalar import TESLA_TO_GAUSS, delta_degrees, k_quality, mode_label
from ringwave.operators import blocks
from ringwave.operators.spectra import _col

SINGULAR_RATIO = 1e15  # columns this much shallower than the deepest depend on the others; such a mode has one component
DEFAULT_SIGMA = 2.0e-5  # fixed: sensor uncertainty in tesla


# ---- mode list and sigma ---------------------------------------------------------------
def mode_list(ns: Sequence[int], ms: Sequence[int], helicity: int = -1) -> list[tuple[int, int]]:
    """(n, m) pairs; m changes sign when none agrees with the helicity, (0, 0) comes first."""
    ms = list(ms)
    if any(ms) and not any(np.sign(m) == helicity for m in ms):
        ms = [-m for m in ms]
    out = [(int(n), int(m)) for m in ms for n in ns]
    if (0, 0) in out:
        out.remove((0, 0))
        out.insert(0, (0, 0))
    return out


def fill_sigma(sensors: DataFrame, *, default: float | None = None, positive: bool = True, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Replace unusable sigmas by ``default`` or by the mean of the usable ones, 1 when there are none."""
    s = F.col("sigma").cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    if positive:
        ok = ok & (s > 0)
    if default is not None:
        return sensors.withColumn("sigma", F.when(ok, s).otherwise(default))
    mean = sensors.groupBy(*keys).agg(F.avg(F.when(ok, s)).alias("_ms"))
    return sensors.join(mean, list(keys)).withColumn("sigma", F.when(ok, s).otherwise(F.coalesce("_ms", F.lit(1.0)))).drop("_ms")


# ---- basis functions ----------------------------------------------------------------------
def _mean_exp(order: int, a: Column, b: Column, width: Column) -> tuple[Column, Column]:
    """Real and imaginary part of the mean of exp(i*order*x) over an interval in degrees."""
    if order == 0:
        return F.lit(1.0), F.lit(0.0)
    d = order * F.radians(width)
    return ((F.sin(order * F.radians(b)) - F.sin(order * F.radians(a))) / d,
            (F.cos(order * F.radians(a)) - F.cos(order * F.radians(b))) / d)


def sinusoid(n: int, m: int, basis: str = "sinusoidal-integral", *, x1="phi_end1", x2="phi_end2", y1="theta_end1", y2="theta_end2") -> tuple[Column, Column]:
    """(re, im) of exp(i(n phi + m theta)) at the sensor centre, or its exact mean over the sensor."""
    a1, a2, b1, b2 = _col(x1), _col(x2), _col(y1), _col(y2)
    dx, dy = delta_degrees(a1, a2), delta_degrees(b1, b2)
    if basis == "sinusoidal-point":
        arg = n * F.radians(a1 + dx / 2.0) + m * F.radians(b1 + dy / 2.0)
        return F.cos(arg), F.sin(arg)
    if basis == "sinusoidal-integral":
        xr, xi = _mean_exp(n, a1, a2, dx)
        yr, yi = _mean_exp(m, b1, b2, dy)
        return xr * yr - xi * yi, xr * yi + xi * yr
    raise ValueError("basis must be sinusoidal-point, sinusoidal-integral, gaussian-point or gaussian-integral")


@F.pandas_udf(T.DoubleType())
def erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


def rbf_axis(low: Column, high: Column, count: int, width: float | None = None) -> Column:
    """Centres, width and periodic copies on one axis as one struct.

    The extent is widened to whole tens. Up to half a circle it is a segment whose two ends are centres; beyond
    it is the whole circle, whose ends are one. The width is the distance of neighbours, infinite for one centre.
    """
    start, stop = (low / 10).cast("long") * 10, F.ceil(high / 10) * 10
    segment = stop - start <= 180
    origin, span = F.when(segment, start).otherwise(0), F.when(segment, stop - start).otherwise(360)
    gap = span.cast("double") / F.when(segment, max(1, count - 1)).otherwise(count)
    reach = F.lit(float(width)) if width else gap if count > 1 else F.lit(math.inf)
    turns = F.when(reach < math.inf, F.greatest(F.lit(1), F.floor(reach / 45))).otherwise(0).cast("int")
    at = F.transform(F.array(*map(F.lit, range(count))), lambda j: origin + gap * j)
    return F.struct(at.alias("cen"), reach.alias("eps"), turns.alias("cycle"))


def rbf_centres(sensors: DataFrame, ncenters: int = 6, mcenters: int = 1, nepsilon: float | None = None, mepsilon: float | None = None,
                *, y: str = "theta", keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Radial-basis centres, widths and copies (``n_cen, n_eps, n_cycle`` toroidal, ``m_...`` poloidal) of each recording's sensors."""
    axes = {"n": ("phi", ncenters, nepsilon), "m": (y, mcenters, mepsilon)}
    ends = {}
    for name, (angle, count, width) in axes.items():
        both = F.array(f"{angle}_end1", f"{angle}_end2")
        ends[name] = rbf_axis(F.min(F.array_min(both)), F.max(F.array_max(both)), count, width).alias(name)
    found = sensors.groupBy(*keys).agg(*ends.values())
    return found.select(*keys, *(F.col(f"{name}.{part}").alias(f"{name}_{part}") for name in axes for part in ("cen", "eps", "cycle")))


def gaussian_terms(sensors: DataFrame, centres: DataFrame, basis: str = "gaussian-point", *, y: str = "theta", keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Basis value per (sensor, centre), summed over periodic copies of the centre."""
    keys = list(keys)
    s = sensors.select(*keys, "channel", "phi_end1", "phi_end2", F.col(f"{y}_end1").alias("y1"), F.col(f"{y}_end2").alias("y2"))
    d = s.join(centres, keys)
    d = d.select("*", F.posexplode("m_cen").alias("_mi", "m")).select("*", F.posexplode("n_cen").alias("_ni", "n"))
    d = d.withColumn("_nc", F.explode(F.sequence(-F.col("n_cycle"), F.col("n_cycle")))).withColumn(
        "_mc", F.explode(F.sequence(-F.col("m_cycle"), F.col("m_cycle"))))
    cx, cy = F.col("n") + F.col("_nc") * 360.0, F.col("m") + F.col("_mc") * 360.0
    ne, me, inf = F.col("n_eps"), F.col("m_eps"), float("inf")
    if basis == "gaussian-point":
        xc = F.col("phi_end1") + delta_degrees("phi_end1", "phi_end2") / 2.0
        yc = F.col("y1") + delta_degrees("y1", "y2") / 2.0
        xt = F.when(ne < inf, ((cx - xc) / ne) ** 2).otherwise(0.0)
        yt = F.when(me < inf, ((cy - yc) / me) ** 2).otherwise(0.0)
        d = d.withColumn("v", F.exp(-(xt + yt)))
    elif basis == "gaussian-integral":
        def safe(e):
            return F.when(e < inf, e).otherwise(1.0)

        d = d.withColumns({
            "_x2": erf((F.col("phi_end2") - cx) / safe(ne)), "_x1": erf((F.col("phi_end1") - cx) / safe(ne)),
            "_y2": erf((F.col("y2") - cy) / safe(me)), "_y1": erf((F.col("y1") - cy) / safe(me))})
        half = 0.5 * math.sqrt(math.pi)
        xi, yi = half * ne * (F.col("_x2") - F.col("_x1")), half * me * (F.col("_y2") - F.col("_y1"))
        d = d.withColumn("v", F.when((ne < inf) & (me < inf), xi * yi).when(ne < inf, xi).otherwise(yi))
    else:
        raise ValueError("basis must be gaussian-point or gaussian-integral")
    return d.groupBy(*keys, "channel", "_mi", "_ni", "n", "m").agg(F.sum("v").alias("v"))


def basis_rows(sensors: DataFrame, *, ns=(1, 2, 3), ms=(0,), helicity: int = -1, basis: str = "sinusoidal-integral", geometry: str = "cylindrical",
               ncenters: int = 6, mcenters: int = 1, nepsilon=None, mepsilon=None, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Per sensor the arrays ``b_re, b_im`` over the modes, plus ``mode_n, mode_m`` and its centre."""
    y = {"cylindrical": "theta", "vertical": "z"}.get(geometry)
    if y is None:
        raise ValueError("geometry must be cylindrical or vertical")
    keys = list(keys)
    if basis.startswith("gaussian"):
        cen = rbf_centres(sensors, ncenters, mcenters, nepsilon, mepsilon, y=y, keys=keys)
        t = gaussian_terms(sensors, cen, basis, y=y, keys=keys).groupBy(*keys, "channel").agg(
            F.sort_array(F.collect_list(F.struct("_mi", "_ni", "n", "m", "v"))).alias("r"))
        rows = t.select(*keys, "channel", F.col("r.v").alias("b_re"), F.transform("r", lambda _: F.lit(0.0)).alias("b_im"),
                        F.col("r.n").alias("mode_n"), F.col("r.m").alias("mode_m"))
        return sensors.join(rows, [*keys, "channel"])
    modes = mode_list(ns, ms, helicity)
    parts = [sinusoid(n, m, basis, y1=f"{y}_end1", y2=f"{y}_end2") for n, m in modes]
    return sensors.withColumns({
        "b_re": F.array(*[p[0] for p in parts]), "b_im": F.array(*[p[1] for p in parts]),
        "mode_n": F.array(*[F.lit(float(n)) for n, _ in modes]), "mode_m": F.array(*[F.lit(float(m)) for _, m in modes]),
        "centre_x": F.radians(F.col("phi_end1") + delta_degrees("phi_end1", "phi_end2") / 2.0),
        "centre_y": F.radians(F.col(f"{y}_end1") + delta_degrees(f"{y}_end1", f"{y}_end2") / 2.0),
    })


# ---- job 1: one small inversion per recording --------------------------------------------------
def invert_design(rows: DataFrame, *, fit_cond: float = 10.0, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Weighted design, pseudo-inverse and condition numbers of each recording's sensor table.

    Input is the sensor table (P rows per recording), never the samples. Every mode has two slots
    (cosine, sine); the sine slot is zero where the mode has a single component.
    """
    keys = list(keys)
    d = rows.withColumn("sigma", F.col("sigma").cast("double"))
    for c in ("centre_x", "centre_y"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(0.0))
    d = d.select(*keys, F.col("channel").cast("string").alias("channel"), "sigma", "b_re", "b_im", "mode_n", "mode_m", "centre_x", "centre_y")
    key_fields = [d.schema[k] for k in keys]
    arr = T.ArrayType(T.DoubleType())

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel", kind="stable")
        sigma = pdf.sigma.to_numpy()[:, None]
        f = (np.stack(pdf.b_re) + 1j * np.stack(pdf.b_im)) / sigma
        mode_n, mode_m = pdf.mode_n.iloc[0], pdf.mode_m.iloc[0]
        # cosine and sine columns alternate; a triangular factor shows which depend on those before
        columns = np.stack([f.real, f.imag], axis=2).reshape(len(f), -1)
        depth = np.abs(np.diag(np.linalg.qr(columns, mode="r")))
        weak = np.zeros(columns.shape[1], bool)
        weak[: len(depth)] = depth <= depth.max() / SINGULAR_RATIO
        plain = np.isclose(f.imag, 0).all(axis=0)
        lone = plain | weak.reshape(-1, 2).any(axis=1)
        turn = np.exp(1j * (np.asarray(mode_n) * pdf.centre_x.iloc[0] + np.asarray(mode_m) * pdf.centre_y.iloc[0]))
        columns[:, ::2] = np.where(lone & ~plain, (f * turn).real, f.real)
        where = [slot for slot in range(columns.shape[1]) if slot % 2 == 0 or not lone[slot // 2]]
        a = columns[:, where]
        u, w, vh = np.linalg.svd(a, full_matrices=False)
        ratio = np.where(w > 0, w[0] / np.where(w > 0, w, 1.0), np.inf)
        inv = np.where(ratio <= fit_cond, 1.0 / np.where(w > 0, w, 1.0), 0.0)
        pinv = (vh.T * inv) @ u.T
        err = np.sqrt(np.sum((vh.T * inv) ** 2, axis=1))
        width = 2 * f.shape[1]
        design, weights, sigmas = np.zeros((len(pdf), width)), np.zeros((len(pdf), width)), np.zeros(width)
        design[:, where], weights[:, where], sigmas[where] = a, (pinv / sigma.T).T, err
        out = pd.DataFrame({"channel": pdf.channel.to_numpy(), "sigma": pdf.sigma.to_numpy(), "design": list(design), "weights": list(weights)})
        for name, val in zip(keys, key):
            out[name] = val
        out["mode_n"], out["mode_m"], out["sigmas"] = [mode_n] * len(out), [mode_m] * len(out), [sigmas] * len(out)
        out["raw_cn"], out["eff_cn"] = float(ratio[-1]), float(np.max(ratio[ratio <= fit_cond]))
        out["rank"], out["n_sensors"] = int(np.sum(inv > 0)), len(out)
        return out

    fields = [*key_fields, T.StructField("channel", T.StringType()), T.StructField("sigma", T.DoubleType()), T.StructField("design", arr),
              T.StructField("weights", arr), T.StructField("mode_n", arr), T.StructField("mode_m", arr), T.StructField("sigmas", arr),
              T.StructField("raw_cn", T.DoubleType()), T.StructField("eff_cn", T.DoubleType()), T.StructField("rank", T.IntegerType()),
              T.StructField("n_sensors", T.IntegerType())]
    return d.groupBy(*keys).applyInPandas(solve, T.StructType(fields))


def fit_meta(inverse: DataFrame, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """One row per recording: modes, sigmas, condition numbers, rank."""
    cols = ["mode_n", "mode_m", "sigmas", "raw_cn", "eff_cn", "rank", "n_sensors"]
    return inverse.groupBy(*keys).agg(*[F.first(c).alias(c) for c in cols])


# ---- job 2: apply to every time slice ------------------------------------------------------------
def fit_coefficients(samples: DataFrame, inverse: DataFrame, n_modes: int, *, keys: Sequence[str] = ("shot",), along: Sequence[str] = ("i", "t_s")) -> DataFrame:
    """``coef`` (two slots per mode) and ``power``, the sum of squared values in units of sigma, at every time: one aggregation by (recording, time)."""
    keys = list(keys)
    d = blocks.join_small(samples, inverse.select(*keys, "channel", "weights", "sigma"), [*keys, "channel"])
    sums = [F.sum(F.col("weights")[j] * F.col("value")).alias(f"_x{j}") for j in range(2 * n_modes)]
    power = F.sum((F.col("value") / F.col("sigma")) ** 2).alias("power")
    return d.groupBy(*keys, *along).agg(*sums, power).select(
        *keys, *along, F.array(*[F.col(f"_x{j}") for j in range(2 * n_modes)]).alias("coef"), "power")


def mode_rows(coef: DataFrame, meta: DataFrame, n_modes: int, *, keys: Sequence[str] = ("shot",), along: Sequence[str] = ("i", "t_s")) -> DataFrame:
    """Long form: one row per (time, mode) with re, im and their sigmas."""
    j = F.array(*[F.lit(k) for k in range(n_modes)])
    d = blocks.join_small(coef, meta.select(*keys, "mode_n", "mode_m", "sigmas"), list(keys)).withColumn("mode", F.explode(j))
    k = 2 * F.col("mode")
    return d.select(
        *keys, *along, "mode", F.get("mode_n", F.col("mode")).alias("n"), F.get("mode_m", F.col("mode")).alias("m"),
        F.get("coef", k).alias("re"), F.get("coef", k + 1).alias("im"),
        F.get("sigmas", k).alias("sigma_re"), F.get("sigmas", k + 1).alias("sigma_im"))


def fitted_signal(samples: DataFrame, coef: DataFrame, inverse: DataFrame, n_modes: int, *, keys: Sequence[str] = ("shot",), along: Sequence[str] = ("i", "t_s")) -> DataFrame:
    """Measured, fitted and residual signal per channel and time."""
    keys = list(keys)
    d = blocks.join_small(samples, inverse.select(*keys, "channel", "sigma", "design"), [*keys, "channel"]).join(coef, [*keys, *along])
    fit = F.lit(0.0)
    for j in range(2 * n_modes):
        fit = fit + F.col("design")[j] * F.col("coef")[j]
    return d.withColumn("fit", fit * F.col("sigma")).withColumn("residual", F.col("value") - F.col("fit")) \
        .select(*keys, "channel", *along, "sigma", "value", "fit", "residual")


def chi_square(coef: DataFrame, inverse: DataFrame, n_modes: int, *, keys: Sequence[str] = ("shot",), along: Sequence[str] = ("i", "t_s")) -> DataFrame:
    """Chi-square and its reduced value at every time, from the coefficients alone.

    A least-squares fit is orthogonal to its residual, so chi-square is the ``power`` less c' G c, with G the products of the
    design columns, a small table per recording; no sample is read again. Every time must hold all channels of the fit,
    as stacked samples do. Rounding may take 1e-16 of the power away; below zero it counts as zero.
    """
    width = range(2 * n_modes)
    pairs = [(i, j) for i in width for j in width if i <= j]
    gram = F.array(*[F.sum(F.col("design")[i] * F.col("design")[j]) for i, j in pairs])
    meta = inverse.groupBy(*keys).agg(gram.alias("_g"), F.first("n_sensors").alias("n_sensors"), F.first("rank").alias("rank"))
    fitted = F.lit(0.0)
    for k, (i, j) in enumerate(pairs):
        fitted = fitted + (1.0 if i == j else 2.0) * F.col("_g")[k] * F.col("coef")[i] * F.col("coef")[j]
    nu = F.greatest(F.col("n_sensors") - F.col("rank"), F.lit(1))
    return blocks.join_small(coef, meta, list(keys)).withColumn("chi_sq", F.greatest(F.lit(0.0), F.col("power") - fitted)).select(
        *keys, *along, "chi_sq", (F.col("chi_sq") / nu).alias("red_chi_sq"))


def amplitude_phase(rows: DataFrame) -> DataFrame:
    """Amplitude and phase with propagated sigmas; a zero amplitude has zero errors."""
    c, s, ec, es = F.col("re"), F.col("im"), F.col("sigma_re"), F.col("sigma_im")
    amp = F.sqrt(c * c + s * s)
    nonzero = F.nullif(amp, F.lit(0.0))
    return rows.withColumns({
        "amplitude": amp,
        "amplitude_error": F.coalesce(F.sqrt((c * ec) ** 2 + (s * es) ** 2) / nonzero, F.lit(0.0)),
        "phase": F.degrees(F.atan2(s, c)),
        "phase_error": F.coalesce(F.degrees(F.sqrt((c * es) ** 2 + (s * ec) ** 2) / (nonzero * nonzero)), F.lit(0.0)),
        "label": mode_label("n", "m"),
    })


# ---- field maps -----------------------------------------------------------------------------------
def _field(rows: DataFrame, keys: Sequence[str], cells: Column, scale: float) -> DataFrame:
    """Sum over modes of Re[c exp(-i(n x + m y))] at all cells.

    The few modes of a key come together before its cells are made, so what is shuffled does not grow with the map.
    """
    modes = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "m", "re", "im"))).alias("_modes"))

    def add(z: Column, mode: Column) -> Column:
        arg = mode["n"] * F.radians(F.col("c.x")) + mode["m"] * F.radians(F.col("c.y"))
        return z + mode["re"] * F.cos(arg) + mode["im"] * F.sin(arg)

    return modes.withColumn("c", F.explode(cells)).select(
        *keys, F.col("c.x").alias("x"), F.col("c.y").alias("y"), (F.aggregate("_modes", F.lit(0.0), add) * scale).alias("z"))


def linspace_col(lo: float, hi: float, points: int) -> Column:
    step = (hi - lo) / (points - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.lit(lo) + j * step)


def field_map(rows: DataFrame, keys: Sequence[str], *, phi_points: int = 73, theta_points: int = 49, scale: float = TESLA_TO_GAUSS) -> DataFrame:
    """Field on a phi x theta grid (x = phi, y = theta) for every key of ``rows``."""
    ys = linspace_col(0.0, 360.0, theta_points)
    cells = F.flatten(F.transform(linspace_col(0.0, 360.0, phi_points), lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return _field(rows, keys, cells, scale)


def phi_time_map(rows: DataFrame, keys: Sequence[str], *, theta: float = 0.0, points: int = 73, scale: float = TESLA_TO_GAUSS) -> DataFrame:
    """Field over phi and time at a fixed poloidal angle."""
    cells = F.transform(linspace_col(0.0, 360.0, points), lambda x: F.struct(x.alias("x"), F.lit(float(theta)).alias("y")))
    return _field(rows, keys, cells, scale)


def theta_time_map(rows: DataFrame, keys: Sequence[str], *, phi: float = 0.0, lo: float = -180.0, hi: float = 180.0, points: int = 120,
                   scale: float = 1.0) -> DataFrame:
    """Field over the poloidal coordinate (theta, or z in a vertical fit) and time at a fixed phi."""
    cells = F.transform(linspace_col(lo, hi, points), lambda y: F.struct(F.lit(float(phi)).alias("x"), y.alias("y")))
    return _field(rows, keys, cells, scale)


# ---- condition number of an array ----------------------------------------------------------------------
def condition_number(sensors: DataFrame, n_max: int = 3, keys: Sequence[str] = ("shot",), angle: str = "phi") -> DataFrame:
    """K of the columns 1, cos n phi, sin n phi; infinite for too few probes or a degenerate array."""
    keys = list(keys)
    d = sensors.select(*keys, F.col(angle).cast("double").alias("phi"))
    key_fields = [d.schema[k] for k in keys]

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        phi, cols = np.deg2rad(pdf.phi.to_numpy()), 2 * n_max + 1
        k = math.inf
        if len(phi) >= cols:
            a = np.column_stack([np.ones_like(phi)] + [f(n * phi) for n in range(1, n_max + 1) for f in (np.cos, np.sin)])
            s = np.linalg.svd(a, compute_uv=False)
            k = float(s[0] / s[-1]) if s[-1] > 0 else math.inf
        return pd.DataFrame([dict(zip(keys, key)) | {"n_probes": len(phi), "k": k}])

    schema = T.StructType([*key_fields, T.StructField("n_probes", T.IntegerType()), T.StructField("k", T.DoubleType())])
    return d.groupBy(*keys).applyInPandas(solve, schema).withColumn("quality", k_quality("k"))
