"""Schemas of the tables the engine reads and writes."""
from __future__ import annotations

SAMPLES = "shot long, channel string, i long, t_ms double, value float"
SHOTS = "shot long, device_id string, device string, analysis string, backend string, source string, tmin double, tmax double, decimate int"
CHANNELS = "shot long, channel string, status string, error string, pointname string, phi double, theta double, gain double, na double"
SENSOR_SEGMENTS = (
    "device_id string, sensor_id string, since_shot long, pointname string, r double, z double, phi double, theta double, "
    "tilt double, length double, delta_phi double, na double, gain double, tree string, pair string"
)
SENSOR_SETS = "device_id string, set_name string, set_ord int, type string, member string, ord int"
FEATURES = "device_id string, kind string, since_shot long, payload string"
DEVICES = "device_id string, name string, r0 double, toroidal_set string, poloidal_set string, qs_default_set string"
PLASMA = "shot long, t_ms double, ip double, bt double"
COUPLING = "shot long, coil string, channel string, dc_coupling double"
EQUILIBRIUM = (
    "shot long, time_ms double, r array<double>, z array<double>, psi_n array<array<double>>, "
    "boundary_r array<double>, boundary_z array<double>, axis_r double, axis_z double, levels array<double>"
)
