"""Era-aware device catalog: segments, pointnames, sensor sets and signal groups."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwave.session import cut_lineage

from ringwave.functions import scalar as X
from ringwave.operators import blocks

SEGMENT_KEYS = ("device_id", "sensor_id")
GEOMETRY = ("r", "z", "phi", "theta", "tilt", "length", "delta_phi", "na", "gain", "tree", "pair")


# ---- eras -------------------------------------------------------------------------------
def with_until(segments: DataFrame, keys: Sequence[str] = SEGMENT_KEYS, since: str = "since_shot", until: str = "until_shot") -> DataFrame:
    """Close each era at the start of the next one (a sensor has a handful of eras)."""
    w = Window.partitionBy(*keys).orderBy(since)
    return segments.withColumn(until, F.lead(since).over(w))


def active_segments(lookups: DataFrame, segments: DataFrame, *, keys: Sequence[str] = SEGMENT_KEYS, at: str = "shot", since: str = "since_shot",
                    width: float = 1000.0, nearest: bool = False) -> DataFrame:
    """The era of each looked-up sensor at its recording, start inclusive.

    Before the first era there is none, or with ``nearest`` the first one (layout views only).
    """
    payload = [c for c in segments.columns if c not in (*keys, since)]
    return blocks.asof_join(lookups, segments, keys, at, since, payload, width, nearest_floor=nearest)


def pointname_at(active: DataFrame, since: str = "since_shot", sensor: str = "sensor_id") -> DataFrame:
    """Name to query at that recording; NULL when out of range or decommissioned."""
    name = F.when(F.col(since).isNotNull(), X.available(F.coalesce("pointname", F.col(sensor))))
    return active.withColumn("pointname", name)


def geometry_at(lookups: DataFrame, segments: DataFrame, **kw) -> DataFrame:
    """Geometry of available sensors only."""
    return pointname_at(active_segments(lookups, segments, **kw)).where(F.col("pointname").isNotNull())


def geometry_nearest(lookups: DataFrame, segments: DataFrame, **kw) -> DataFrame:
    """Like :func:`geometry_at`; a sensor without a usable era there gets its earliest geometry."""
    keys = kw.get("keys", SEGMENT_KEYS)
    payload = [c for c in segments.columns if c not in (*keys, "since_shot")]
    first = segments.groupBy(*keys).agg(F.min_by(F.struct("since_shot", *payload), "since_shot").alias("_first"))
    d = pointname_at(active_segments(lookups, segments, **kw)).join(first, list(keys))
    usable = F.col("pointname").isNotNull()
    return d.select(*lookups.columns, *[F.when(usable, F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c) for c in ("since_shot", *payload)])


def feature_at(lookups: DataFrame, features: DataFrame, width: float = 1000.0) -> DataFrame:
    """Active wall, vessel or coil record per (device, kind, shot)."""
    return active_segments(lookups, features, keys=("device_id", "kind"), width=width)


def resolve_pointnames(requested: DataFrame, segments: DataFrame, width: float = 1000.0) -> DataFrame:
    """Queried name per requested id; unmodelled ids pass through, unavailable ones are flagged skipped."""
    modelled = segments.select(*SEGMENT_KEYS).distinct().withColumn("_known", F.lit(True))
    d = pointname_at(active_segments(requested, segments, width=width)).join(modelled, list(SEGMENT_KEYS), "left")
    known = F.coalesce("_known", F.lit(False))
    return d.select(
        *requested.columns, F.when(known, F.col("pointname")).otherwise(F.col("sensor_id")).alias("query"),
        (known & F.col("pointname").isNull()).alias("skipped"))


def relabel(fetched: DataFrame, resolved: DataFrame) -> DataFrame:
    """Give fetched channels their canonical id back and keep the queried name."""
    names = resolved.where(~F.col("skipped")).select("shot", F.col("query").alias("channel"), F.col("sensor_id").alias("_id"))
    d = fetched.join(names, ["shot", "channel"], "left")
    return d.withColumn("pointname", F.when(F.col("_id") != F.col("channel"), F.col("channel"))) \
        .withColumn("channel", F.coalesce("_id", "channel")).drop("_id")


def collapse_eras(states: DataFrame, keys: Sequence[str], since: str, state: Sequence[str]) -> DataFrame:
    """Merge consecutive equal states; the first era of each key starts at zero."""
    w = Window.partitionBy(*keys).orderBy(since)
    cur = F.struct(*state)
    d = states.withColumn("_prev", F.lag(cur).over(w)).withColumn("_rn", F.row_number().over(w))
    d = d.where((F.col("_rn") == 1) | ~cur.eqNullSafe(F.col("_prev")))
    return d.withColumn(since, F.when(F.col("_rn") == 1, 0).otherwise(F.col(since))).drop("_prev", "_rn")


def rekey_first_era(segments: DataFrame, survivors: DataFrame, coil_prefixes: Sequence[str], legacy: int = 124400, upgrade: int = 151593) -> DataFrame:
    """Start the first era at the legacy floor for survivors and coils, else at the upgrade."""
    w = Window.partitionBy(*SEGMENT_KEYS).orderBy("since_shot")
    coil = F.lit(False)
    for p in coil_prefixes:
        coil = coil | F.col("sensor_id").startswith(p)
    coil = coil & F.col("sensor_id").rlike("[0-9]")
    d = segments.withColumn("_rn", F.row_number().over(w)).join(survivors.select("sensor_id").distinct().withColumn("_s", F.lit(True)), "sensor_id", "left")
    floor = F.when(F.coalesce("_s", F.lit(False)) | coil, legacy).otherwise(upgrade)
    return d.withColumn("since_shot", F.when(F.col("_rn") == 1, floor).otherwise(F.col("since_shot"))).drop("_rn", "_s").select(*segments.columns)


# ---- sensor sets -------------------------------------------------------------------------
def set_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``device_id, root, node, path``: every set that a root holds, by the least path of positions in the lists.

    Breadth first from all roots at once: each round follows only the pairs whose path got less in the round before,
    so there are as many rows as pairs, whatever the number of paths, and no limit on depth. A set met again on its
    own path has a longer path than before and is not followed.
    """
    key = ["device_id", "root", "node"]
    none = F.array().cast("array<int>")
    state = cut_lineage(roots.select("device_id", F.col("set_name").alias("root"), F.col("set_name").alias("node"), none.alias("path"), F.lit(0).alias("round")))
    edges = cut_lineage(edges.select("device_id", F.col("set_name").alias("node"), "child", F.col("ord").cast("int").alias("ord")))
    done = 0
    while state.where(F.col("round") == done).limit(1).count():
        met = state.where(F.col("round") == done).join(edges, ["device_id", "node"]).select(
            "device_id", "root", F.col("child").alias("node"), F.array_append("path", F.col("ord")).alias("path"), F.lit(done + 1).alias("round"))
        least = state.unionByName(met).groupBy(*key).agg(F.min(F.struct("path", "round")).alias("_m"))
        state = cut_lineage(least.select(*key, "_m.path", "_m.round"))
        done += 1
    return state.drop("round")


def flatten_sets(spark: SparkSession, sets: DataFrame, *, strict: bool = False) -> DataFrame:
    """Members of every set with composites expanded, first mention kept.

    ``sets``: device_id, set_name, type (list | composite), member, ord. Only the set-to-set edges are followed;
    the (possibly long) member lists are joined once afterwards. ``strict`` raises on unknown members of
    composites, on unknown types and on sets that hold themselves; else they hold nothing more.
    """
    roots = sets.select("device_id", "set_name").distinct()
    edges = sets.where(F.col("type") == "composite").select("device_id", "set_name", F.col("member").alias("child"), "ord")
    if strict:
        unknown = edges.join(roots.withColumnRenamed("set_name", "child"), ["device_id", "child"], "left_anti").select(F.concat(F.lit("unknown sensor set "), "child"))
        odd = sets.where(~F.coalesce(F.col("type").isin("list", "composite"), F.lit(False))).select(
            F.concat_ws(" ", F.lit("sensor set"), "set_name", F.lit("has unknown type"), "type"))
        bad = unknown.union(odd).limit(1).collect()
        if bad:
            raise ValueError(bad[0][0])
    reach = set_closure(edges, roots)
    if strict:
        back = edges.select("device_id", F.col("set_name").alias("node"), F.col("child").alias("root"))
        bad = reach.join(back, ["device_id", "root", "node"]).limit(1).collect()
        if bad:
            raise ValueError(f"sensor set {bad[0]['root']} holds itself")
    members = sets.where(F.col("type") == "list").select("device_id", F.col("set_name").alias("node"), "member", "ord")
    full = reach.join(members, ["device_id", "node"]).withColumn("path", F.array_append("path", F.col("ord").cast("int")))
    return full.groupBy("device_id", F.col("root").alias("set_name"), "member").agg(F.min("path").alias("path"))


def set_summary(flat: DataFrame) -> DataFrame:
    """Kind, size and ordered members of each set."""
    return flat.groupBy("device_id", "set_name").agg(
        F.count(F.lit(1)).alias("count"), F.transform(F.sort_array(F.collect_list(F.struct("path", "member"))), lambda x: x["member"]).alias("members"),
    ).withColumn("kind", F.coalesce(X.kind_from_set_name("set_name"), F.lit("coil")))


def first_set(sets: DataFrame) -> DataFrame:
    """First list set that names each sensor, and the kind it implies."""
    d = sets.where(F.col("type") == "list")
    pick = d.groupBy("device_id", F.col("member").alias("channel")).agg(F.min_by("set_name", F.struct("set_ord", "ord")).alias("family"))
    return pick.withColumn("kind", F.coalesce(X.kind_from_set_name("family"), F.lit("Bp")))


def channel_filter(channels: DataFrame, wanted: Sequence[str] | str, flat: DataFrame, *, column: str = "channel") -> DataFrame:
    """Channels of the named sets (underscore = space) or matching the patterns from their start."""
    items = [wanted] if isinstance(wanted, str) else list(wanted)
    keyed = flat.withColumn("_key", X.set_name_key("set_name"))
    asked = channels.sparkSession.createDataFrame([(w,) for w in items], "w string").withColumn("_key", X.set_name_key("w"))
    known = asked.join(keyed.select("_key").distinct(), "_key", "left_semi")
    members = keyed.join(known, "_key", "left_semi").select(F.col("member").alias(column)).distinct()
    patterns = asked.join(known.select("_key"), "_key", "left_anti").select("w")
    by_name = channels.join(members, column, "left_semi")
    by_pattern = channels.select(column).distinct().join(
        F.broadcast(patterns), F.rlike(F.col(column), F.concat(F.lit("^(?:"), F.col("w"), F.lit(")"))), "left_semi")  # the caller's short list
    return by_name.unionByName(channels.join(by_pattern, column, "left_semi")).distinct()


def exclude(channels: DataFrame, patterns: Sequence[str], column: str = "channel") -> DataFrame:
    cond = F.lit(True)
    for p in patterns:
        cond = cond & ~F.col(column).rlike(f"^(?:{p})")
    return channels.where(cond)


def live_channels(samples: DataFrame) -> DataFrame:
    """Channels with at least one real value."""
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    return samples.groupBy("shot", "channel").agg(F.bool_or(ok).alias("_ok")).where("_ok").drop("_ok")


# ---- signal catalog ---------------------------------------------------------------------------
def signals_for(analysis_groups: DataFrame, signal_groups: DataFrame) -> DataFrame:
    """Ordered, duplicate-free pointnames of each analysis."""
    d = analysis_groups.withColumnRenamed("ord", "g_ord").join(signal_groups.withColumnRenamed("ord", "s_ord"), "group")
    return d.groupBy("analysis", "pointname").agg(F.min(F.struct("g_ord", "s_ord")).alias("pos"), F.min_by("group", F.struct("g_ord", "s_ord")).alias("group")) \
        .select("analysis", "pointname", "group", "pos.g_ord", "pos.s_ord")


def tree_signals_for(analysis_tree: DataFrame, candidates: DataFrame) -> DataFrame:
    return analysis_tree.join(candidates, "name").select("analysis", "name", "rank", "tree", "node")


def first_usable(candidates: DataFrame, keys: Sequence[str], rank: str, usable: Column, payload: Sequence[str]) -> DataFrame:
    """Best-ranked usable candidate per key."""
    return candidates.where(usable).groupBy(*keys).agg(F.min_by(F.struct(rank, *payload), rank).alias("_p")).select(*keys, "_p.*")


def plasma_candidates(entries: DataFrame) -> DataFrame:
    """Name and ordered (tree, node) candidates from a JSON or bare-name context entry."""
    parsed = F.from_json("entry", "name string, tree string, node string")
    d = entries.withColumn("_e", F.when(F.col("entry").startswith("{"), parsed))
    name = F.coalesce(F.col("_e.name"), F.col("entry"))
    slash = F.when(name.startswith("\\"), name).otherwise(F.concat(F.lit("\\"), name))
    results = F.concat(F.lit("\\top.results.aeqdsk:"), F.ltrim(name, F.lit("\\")))
    cand = F.when(F.col("_e.tree").isNull() | (F.col("_e.tree") == ""), F.array().cast("array<struct<tree:string,node:string>>")) \
        .when(F.col("_e.node").isNotNull() & (F.col("_e.node") != ""), F.array(F.struct(F.col("_e.tree").alias("tree"), F.col("_e.node").alias("node")))) \
        .otherwise(F.array(F.struct(F.col("_e.tree").alias("tree"), slash.alias("node")), F.struct(F.col("_e.tree").alias("tree"), results.alias("node"))))
    return d.withColumns({"name": name, "candidates": cand}).drop("_e")


def resolve_device(names: DataFrame, devices: DataFrame) -> DataFrame:
    """Device id from an id in any case, or from the exact display name."""
    ids = devices.select(F.col("device_id").alias("_id1"), F.lower("device_id").alias("_k1"))
    shown = devices.select(F.col("device_id").alias("_id2"), F.col("name").alias("_k2"))
    d = names.join(ids, F.lower("device") == F.col("_k1"), "left").join(shown, F.col("device") == F.col("_k2"), "left")
    return d.withColumn("device_id", F.coalesce("_id1", "_id2")).drop("_id1", "_k1", "_id2", "_k2")


def missing_report(channels: DataFrame, shown: int = 12, keys: Sequence[str] = ("shot",)) -> DataFrame:
    """Missing channels per reason: how many, and the first dozen names.

    The names are picked by rank inside the reason, so a reason shared by very many channels does
    not collect them all.
    """
    keys = list(keys)
    bad = channels.where(F.col("status") == "missing").withColumn("reason", F.coalesce(F.nullif("error", F.lit("")), F.lit("unknown")))
    w = Window.partitionBy(*keys, "reason").orderBy("channel")
    names = bad.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= shown).groupBy(*keys, "reason").agg(
        F.concat_ws(", ", F.array_sort(F.collect_list("channel"))).alias("names"))
    counts = bad.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(names, [*keys, "reason"]).withColumn("more", F.col("n") > shown)


# ---- geometry records -------------------------------------------------------------------------
def sensor_records(active: DataFrame, families: DataFrame, r0: Column | float = 1.69) -> DataFrame:
    """Full record per channel: angles with their fallbacks, family, kind, shape and end points."""
    d = active.join(families, ["device_id", "sensor_id"], "left")
    fam = F.coalesce("family", F.lit("?"))
    real = X.poloidal_angle("theta", "r", "z", r0)
    d = d.withColumns({
        "family": fam, "kind": F.coalesce("kind", X.kind_from_family(fam)),
        "phi": F.coalesce("phi", X.phi_from_name("sensor_id")), "real_theta": real,
        "theta": F.coalesce(real, X.cosmetic_theta("sensor_id", fam)), "shape": X.sensor_shape("delta_phi"),
    })
    return d.withColumns(X.endpoint_columns(r0))
