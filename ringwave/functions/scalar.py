"""Scalar column expressions: angles, names, units, labels. Everything stays in the JVM."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")

# ---- fixed values (must equal the documented ones) -------------------------
TESLA_TO_GAUSS = 1.0e4
LOOP_MIN_DELTA_PHI = 5.0
KAPPA_RANGE = (1.0, 4.0)
K_WARN, K_BAD = 10.0, 20.0
GATE_POSITIONS, GATE_HEADROOM = 1000.0, (100.0, 0.5)
FAMILY_KIND = {
    "MPID": "Bp", "MPI_BDOT": "Bp", "MPIF": "Bp", "ISLD": "Br",
    "ISLF": "Br", "ESLD": "Br", "COILS": "coil", "AUX": "aux",
}
ARRAY_THETA = {
    "66": 0.0, "67": 15.0, "79": -15.0, "1": 40.0,
    "2": 80.0, "3": 120.0, "4": 160.0, "5": 200.0,
}
ARRAY_NUMBER = r"^[A-Za-z]+(\d+)"
RING_THETA, RING_LETTER = {"B": 8.0}, r"\d+([AB])"
COIL_ROW_THETA, COIL_ROW = {"IU": 60.0, "IL": -60.0}, r"^(?:PC)?(IU|IL)"
# -----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def round_to(x, digits: int) -> Column:
    """``round(x, digits)`` of doubles, the same digits without decimal arithmetic for every row.

    A scaled value well away from a tie and small enough to have exact neighbours is rounded as an integer;
    one division by a power of ten gives the double nearest to the decimal. All others take ``round``.
    """
    scaled = _c(x) * 10.0**digits
    near = F.rint(scaled)
    plain = (F.abs(scaled) < 1e12) & (F.abs(scaled - near) < 0.499)
    return F.when(plain, near / 10.0**digits).otherwise(F.round(_c(x), digits))


# ---- angles ------------------------------------------------------------------
def wrap180(x) -> Column:
    """Wrap degrees into [-180, 180)."""
    return F.pmod(_c(x) + 180.0, F.lit(360.0)) - 180.0


def wrap360(x) -> Column:
    """Wrap degrees into [0, 360)."""
    return F.pmod(_c(x), F.lit(360.0))


def delta_degrees(a, b) -> Column:
    """Width from ``a`` to ``b`` with a single wrap; +/-180 is kept as is."""
    d = _c(b) - _c(a)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def poloidal_angle(theta, r, z, r0) -> Column:
    """An explicit theta wins; else the angle of (r, z) about (r0, 0). Degrees in [0, 360)."""
    return F.coalesce(wrap360(theta), wrap360(F.degrees(F.atan2(_c(z), _c(r) - _c(r0)))))


def theta_star(theta, kappa) -> Column:
    """Elongation-corrected angle; a NULL kappa leaves theta unchanged."""
    t = F.radians(_c(theta))
    star = wrap360(F.degrees(F.atan2(F.sin(t), _c(kappa) * F.cos(t))))
    return F.when(_c(kappa).isNull(), _c(theta)).otherwise(star)


def straight_field_angle(theta, l1, l2=0.0) -> Column:
    """``t - l1 sin t - l2 sin 2t`` in radians, returned in degrees."""
    t = F.radians(_c(theta))
    return F.degrees(t - _c(l1) * F.sin(t) - _c(l2) * F.sin(2 * t))


def remove_toroidal_ramp(phase, n, phi) -> Column:
    """Take the n*phi ramp out of a poloidal phase."""
    return wrap360(_c(phase) + _c(n) * _c(phi))


def endpoint_columns(r0) -> dict[str, Column]:
    """End points of a straight sensor of ``length``/``tilt`` spanning ``delta_phi``."""
    half, tilt = F.col("length") / 2.0, F.radians(F.col("tilt"))
    r1, r2 = F.col("r") - half * F.cos(tilt), F.col("r") + half * F.cos(tilt)
    z1, z2 = F.col("z") - half * F.sin(tilt), F.col("z") + half * F.sin(tilt)
    return {
        "r_end1": r1, "r_end2": r2, "z_end1": z1, "z_end2": z2,
        "phi_end1": F.col("phi") - F.col("delta_phi") / 2.0,
        "phi_end2": F.col("phi") + F.col("delta_phi") / 2.0,
        "theta_end1": F.degrees(F.atan2(z1, r1 - _c(r0))),
        "theta_end2": F.degrees(F.atan2(z2, r2 - _c(r0))),
    }


def no_wrap(angles) -> Column:
    """Array of angles: a span above 240 degrees lifts the minimum by one turn."""
    a = _c(angles)
    lo, hi = F.array_min(a), F.array_max(a)
    return F.when(hi - lo > 240, F.transform(a, lambda x: F.when(x == lo, x + 360.0).otherwise(x))).otherwise(a)


# ---- names and labels -----------------------------------------------------------
def phi_from_name(name) -> Column:
    """Last digit run of a name, modulo a full turn; NULL when there is none."""
    digits = F.regexp_extract(_c(name), r"(\d+)\D*$", 1)
    return F.when(digits != "", F.pmod(digits.cast("long"), F.lit(360).cast("long")).cast("double"))


def shot_from_filename(path) -> Column:
    """All digits of the file stem read as one number, 0 when there are none."""
    stem = F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    digits = F.regexp_replace(stem, r"[^0-9]", "")
    return F.when(digits == "", F.lit(0)).otherwise(digits).cast("long")


def family_of_name(name) -> Column:
    """First run of letters in a name, the name itself when it has none."""
    run = F.regexp_extract(_c(name), "[A-Za-z]+", 0)
    return F.when(run != "", run).otherwise(_c(name))


def kind_from_prefix(family) -> Column:
    f = _c(family)
    return (
        F.when(f.startswith("MPI"), "Bp")
        .when(f.startswith("ISL") | f.startswith("ESL"), "Br")
        .otherwise("coil")
    )


def kind_from_set_name(set_name) -> Column:
    """Sensor kind told by a set's name, NULL when it tells nothing."""
    s = F.lower(_c(set_name))
    return (
        F.when(s.contains("coil"), "coil")
        .when(s.contains("bp"), "Bp")
        .when(s.contains("br") | s.contains("saddle"), "Br")
        .when(s.contains("mirnov") | s.contains("toroidal") | s.contains("poloidal"), "Bp")
    )


def kind_from_family(family) -> Column:
    pairs = [F.lit(v) for kv in FAMILY_KIND.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _c(family)), F.lit("other"))


def _part_value(name: Column, pattern: str, values: dict[str, float]) -> Column:
    """The fixed value of a part of a name, 0 where the part is missing or unknown."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_extract(name, pattern, 1)), F.lit(0.0))


def cosmetic_theta(name, family) -> Column:
    """Layout-only poloidal offset for sensors without any real angle, summed from the parts of the name."""
    n = _c(name)
    probe = _part_value(n, ARRAY_NUMBER, ARRAY_THETA) + _part_value(n, RING_LETTER, RING_THETA)
    return F.when(_c(family) == "COILS", _part_value(n, COIL_ROW, COIL_ROW_THETA)).otherwise(probe)


def sensor_shape(delta_phi) -> Column:
    return F.when(_c(delta_phi) > LOOP_MIN_DELTA_PHI, "loop").otherwise("point")


def mode_label(n, m) -> Column:
    ni, mi = F.rint(_c(n)).cast("int"), F.rint(_c(m)).cast("int")
    return F.when(mi == 0, F.concat(F.lit("n="), ni)).otherwise(F.concat(F.lit("m/n="), mi, F.lit("/"), ni))


def k_quality(k) -> Column:
    c = _c(k)
    return F.when(F.isnan(c) | (c > K_BAD), "bad").when(c > K_WARN, "warn").otherwise("good")


def loose_name(name) -> Column:
    """Spelling-insensitive device name."""
    return F.regexp_replace(F.lower(_c(name)), "[^a-z0-9]", "")


def set_name_key(name) -> Column:
    """Underscores and spaces are the same in a set name."""
    return F.replace(F.trim(_c(name)), F.lit("_"), F.lit(" "))


def int_list(text) -> Column:
    """Parse ``"1,2,3"`` into an int array, skipping blanks."""
    parts = F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("int"))


# ---- units and cleaning -----------------------------------------------------------
def calibrated(value, gain, na) -> Column:
    return _c(value) * F.coalesce(_c(gain), F.lit(1.0)) / F.coalesce(F.nullif(_c(na), F.lit(0.0)), F.lit(1.0))


def to_ms(t, unit) -> Column:
    second = F.lower(_c(unit)).isin("s", "sec", "secs", "second", "seconds")
    return _c(t) * F.when(second, 1000.0).otherwise(1.0)


def known_window_bound(text) -> Column:
    """A stored window bound; the whole-record marker ``*`` and other text become NULL."""
    return F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")


def available(pointname) -> Column:
    """Decommissioned pointnames become NULL."""
    return F.when(F.lower(_c(pointname)) != "notavailable", _c(pointname))


def sane_kappa(k) -> Column:
    return F.when(_c(k).between(*KAPPA_RANGE), _c(k))


def nan_array(arr) -> Column:
    return F.transform(_c(arr), lambda x: F.coalesce(x, F.lit(NAN)))


def gate_percentile(position) -> Column:
    """Slider position to percentile, logarithmic in the headroom, one decimal."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(position) / GATE_POSITIONS))
    lo, hi = GATE_HEADROOM
    headroom = F.exp(F.log(F.lit(lo)) * (1 - t) + F.log(F.lit(hi)) * t)
    return F.floor((100 - headroom) * 10 + 0.5) / 10


def clean_json(struct_col) -> Column:
    """JSON without null keys."""
    return F.to_json(_c(struct_col), {"ignoreNullFields": "true"})


def rounded(x, digits: int) -> Column:
    """Round and drop the sign of zero, so results compare byte for byte."""
    return F.round(_c(x), digits) + F.lit(0.0)


def total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def register_sql_functions(spark) -> None:
    """Temporary SQL functions for the angle helpers."""
    d = "DOUBLE"
    bodies = {
        f"wrap180(x {d})": "pmod(x + 180D, 360D) - 180D",
        f"wrap360(x {d})": "pmod(x, 360D)",
        f"delta_degrees(a {d}, b {d})": (
            "CASE WHEN b - a > 180 THEN b - a - 360 WHEN b - a < -180 THEN b - a + 360 ELSE b - a END"
        ),
        f"poloidal_angle(theta {d}, r {d}, z {d}, r0 {d})": (
            "coalesce(pmod(theta, 360D), pmod(degrees(atan2(z, r - r0)), 360D))"
        ),
        f"theta_star(theta {d}, kappa {d})": (
            "CASE WHEN kappa IS NULL THEN theta ELSE "
            "pmod(degrees(atan2(sin(radians(theta)), kappa * cos(radians(theta)))), 360D) END"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
