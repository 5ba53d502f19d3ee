"""Device description files (one JSON object per device) to tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwave.operators.catalog import GEOMETRY

_SEG = (
    "since_shot long, pointname string, r double, z double, phi double, theta double, tilt double, length double, "
    "delta_phi double, na double, gain double, tree string, pair string"
)
_SEGMENT = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split() for x in _SEG.split(", "))) + ">"
_SENSOR = f"struct<segments:array<{_SEGMENT}>,{_SEGMENT[7:-1]}>"
_FEATURES = ("first_wall", "vacuum_vessel", "coils", "wall")
_SCHEMA = (
    f"name string, R0 double, sensors map<string,{_SENSOR}>, "
    "sensor_sets map<string,struct<type:string,sensors:array<string>,sets:array<string>>>, "
    "arrays struct<toroidal:string,poloidal:string>, qs_default_set string, "
    + ", ".join(f"{f} string" for f in _FEATURES)
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; the device id is the file stem."""
    d = spark.read.schema(_SCHEMA).option("multiLine", True).json(path)
    return d.withColumn("device_id", F.lower(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))


def devices(raw: DataFrame) -> DataFrame:
    return raw.select("device_id", "name", F.coalesce("R0", F.lit(1.69)).alias("r0"), F.col("arrays.toroidal").alias("toroidal_set"),
                      F.col("arrays.poloidal").alias("poloidal_set"), "qs_default_set")


def sensor_segments(raw: DataFrame) -> DataFrame:
    """All eras; a flat sensor record counts as one era from shot 0."""
    d = raw.select("device_id", F.explode("sensors").alias("sensor_id", "s"))
    flat = F.struct(F.lit(0).cast("long").alias("since_shot"), "s.pointname", *[F.col(f"s.{g}") for g in GEOMETRY])
    seg = F.explode(F.when(F.col("s.segments").isNotNull(), F.transform("s.segments", lambda x: F.struct(
        F.coalesce(x["since_shot"], F.lit(0).cast("long")).alias("since_shot"), x["pointname"].alias("pointname"),
        *[x[g].alias(g) for g in GEOMETRY]))).otherwise(F.array(flat)))
    return d.select("device_id", "sensor_id", seg.alias("g")).select("device_id", "sensor_id", "g.*")


def sensor_sets(raw: DataFrame) -> DataFrame:
    """Members of list and composite sets in order."""
    sets = F.map_entries("sensor_sets")
    d = raw.select("device_id", F.posexplode(sets).alias("set_ord", "e"))
    members = F.when(F.col("e.value.type") == "composite", F.col("e.value.sets")).otherwise(F.col("e.value.sensors"))
    return d.select("device_id", F.col("e.key").alias("set_name"), "set_ord", F.col("e.value.type").alias("type"), F.posexplode(members).alias("ord", "member"))


def features(raw: DataFrame) -> DataFrame:
    """Wall, vessel and coil eras; their payload stays JSON because its shape differs by kind."""
    out = None
    for kind in _FEATURES:
        item = F.from_json(kind, "struct<segments:array<string>>")
        eras = F.explode(F.coalesce(item["segments"], F.array(F.col(kind))))
        d = raw.where(F.col(kind).isNotNull()).select("device_id", F.lit(kind).alias("kind"), eras.alias("payload"))
        d = d.select("device_id", "kind", F.coalesce(F.get_json_object("payload", "$.since_shot").cast("long"), F.lit(0).cast("long")).alias("since_shot"), "payload")
        out = d if out is None else out.unionByName(d)
    return out
