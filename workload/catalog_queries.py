"""Device catalog rules: eras, names, sets, groups, reports, geometry records."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ringwave.functions import scalar as X
from ringwave.operators import catalog, summaries
from ringwave.session import checkpoint_dir, cut_lineage
from ringwave.sources import lake
from ringwave.sources.lake import Lake
from workload.inputs import LI, event_samples, micros, stacked_lines, table
from workload.registry import out, query, r

DAY = 86400e6
ERA = """er as (select o_custkey as sensor, epoch_us(o_orderdate) / 86400000000 as since, max(o_orderkey) as okey, arg_max(o_totalprice, o_orderkey) as price,
  arg_max({'p': case when o_orderstatus = 'P' then 'NotAvailable' when o_orderpriority = '5-LOW' then null else o_orderpriority end}, o_orderkey).p as pt0, arg_max(o_orderstatus, o_orderkey) as st from orders group by all),
eu as (select *, lead(since) over (partition by sensor order by since) as until from er)"""


def eras(spark, sf):
    """Every order opens an era of its customer; one era per day."""
    name = F.when(F.col("o_orderstatus") == "P", "NotAvailable").when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority"))
    o = table(spark, sf, "orders").select(F.lit("d").alias("device_id"), F.col("o_custkey").cast("string").alias("sensor_id"), (micros("o_orderdate") / DAY).alias("since_shot"),
                                          "o_orderkey", F.col("o_totalprice").alias("price"), name.alias("pointname"))
    return o.groupBy("device_id", "sensor_id", "since_shot").agg(F.max_by(F.struct("price", "pointname"), "o_orderkey").alias("p")).select("device_id", "sensor_id", "since_shot", "p.*")


def lookups(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.lit("d").alias("device_id"), F.col("o_custkey").cast("string").alias("sensor_id"), (micros("l_shipdate") / DAY).alias("shot"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


LOOK = """lk as (select o_custkey as sensor, epoch_us(l_shipdate) / 86400000000 as day, l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem join orders on o_orderkey = l_orderkey)"""


@query("geometry_asof", f"""with {LOOK}, {ERA}
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, since as since_shot, price from lk left join eu on eu.sensor = lk.sensor and day >= since and (until is null or day < until)""")
def geometry_asof(spark, sf):
    d = catalog.active_segments(lookups(spark, sf), eras(spark, sf).drop("pointname"), width=365.0)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "since_shot", "price")


@query("pointname_at", f"""with {LOOK}, {ERA}
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when since is null then null when lower(coalesce(pt0, lk.sensor::varchar)) = 'notavailable' then null else coalesce(pt0, lk.sensor::varchar) end as pointname
from lk left join (select eu.*, from eu) eu on eu.sensor = lk.sensor and day >= since and (until is null or day < until)""")
def pointname_at(spark, sf):
    d = catalog.pointname_at(catalog.active_segments(lookups(spark, sf), eras(spark, sf), width=365.0))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "pointname")


@query("geometry_strict", f"""with {LOOK}, {ERA}
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, price from lk join eu on eu.sensor = lk.sensor and day >= since and (until is null or day < until)
where lower(coalesce(pt0, 'x')) <> 'notavailable'""")
def geometry_strict(spark, sf):
    return catalog.geometry_at(lookups(spark, sf), eras(spark, sf), width=365.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "price")


@query("geometry_nearest", f"""with {LOOK}, {ERA}, f as (select sensor, arg_min(price, since) as p0 from er group by sensor)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, case when since is null or lower(coalesce(pt0, 'x')) = 'notavailable' then p0 else price end as price
from lk join f on f.sensor = lk.sensor left join eu on eu.sensor = lk.sensor and day >= since and (until is null or day < until)""")
def geometry_nearest(spark, sf):
    return catalog.geometry_nearest(lookups(spark, sf), eras(spark, sf), width=365.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "price")


ALIAS = f"""with {ERA}, rq as (select distinct l_suppkey as shot, case when l_partkey % 3 = 0 then 'x' || (l_partkey % 50) else (l_partkey % 1000)::varchar end as sensor from lineitem),
kn as (select distinct sensor::varchar as sensor from er)
select rq.shot, rq.sensor as sensor_id, case when kn.sensor is null then rq.sensor when since is null or lower(coalesce(pt0, 'x')) = 'notavailable' then null else coalesce(pt0, rq.sensor) end as query,
  kn.sensor is not null and (since is null or lower(coalesce(pt0, 'x')) = 'notavailable') as skipped
from rq left join kn on kn.sensor = rq.sensor left join eu on eu.sensor::varchar = rq.sensor and 9000 + rq.shot * 20 >= since and (until is null or 9000 + rq.shot * 20 < until)"""


def resolved_names(spark, sf):
    k = F.col("l_partkey")
    rq = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.when(k % 3 == 0, F.concat(F.lit("x"), k % 50)).otherwise((k % 1000).cast("string")).alias("sensor_id")).distinct()
    rq = rq.select(F.lit("d").alias("device_id"), "sensor_id", (9000 + F.col("s") * 20).cast("double").alias("shot"))
    return catalog.resolve_pointnames(rq, eras(spark, sf), width=365.0)


@query("alias_resolution", ALIAS)
def alias_resolution(spark, sf):
    """Names to query per recording; unmodelled ids pass through, unavailable ones are skipped."""
    d = resolved_names(spark, sf)
    return d.select(((F.col("shot") - 9000) / 20).cast("long").alias("shot"), "sensor_id", "query", "skipped")


@query("relabel", f"select shot, sensor_id as channel, case when sensor_id <> query then query end as pointname from ({ALIAS}) where not skipped")
def relabel(spark, sf):
    """Fetched channels by their canonical id again; a name that several sensors share gives a row each."""
    names = cut_lineage(resolved_names(spark, sf))
    fetched = names.where(~F.col("skipped")).select("shot", F.col("query").alias("channel")).distinct()
    d = catalog.relabel(fetched, names)
    return d.select(((F.col("shot") - 9000) / 20).cast("long").alias("shot"), "channel", "pointname")


@query("feature_at", f"""with {LOOK}, {ERA}
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, since as since_shot, price from lk left join eu on eu.sensor = lk.sensor and day >= since and (until is null or day < until)""")
def feature_at(spark, sf):
    """Walls, vessels and coils keep eras like sensors do, by device and kind."""
    walls = eras(spark, sf).drop("pointname").withColumnRenamed("sensor_id", "kind")
    d = catalog.feature_at(lookups(spark, sf).withColumnRenamed("sensor_id", "kind"), walls, width=365.0)
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "since_shot", "price")


@query("era_intervals", f"with {ERA} select sensor::varchar as sensor_id, since as since_shot, until as until_shot, price from eu")
def era_intervals(spark, sf):
    return catalog.with_until(eras(spark, sf)).select("sensor_id", "since_shot", "until_shot", "price")


@query("era_collapse", f"""with {ERA}, c as (select *, lag(st) over w as pv, row_number() over w as rn from er window w as (partition by sensor order by since))
select sensor::varchar as sensor_id, case when rn = 1 then 0 else since end as since_shot, st as state from c where rn = 1 or st is distinct from pv""")
def era_collapse(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("sensor_id"), (micros("o_orderdate") / DAY).alias("since_shot")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("state"))
    return catalog.collapse_eras(o, ["sensor_id"], "since_shot", ["state"])


@query("era_rekey", f"""with {ERA}, sv as (select c_custkey from customer where c_mktsegment = 'BUILDING'), c as (select *, row_number() over (partition by sensor order by since) as rn from er)
select 'C' || sensor as sensor_id, case when rn > 1 then since when sv.c_custkey is not null or sensor % 2 = 0 then 124400 else 151593 end as since_shot, price from c left join sv on sv.c_custkey = sensor
where sensor % 2 = 0 union all
select 'M' || sensor, case when rn > 1 then since when sv.c_custkey is not null then 124400 else 151593 end, price from c left join sv on sv.c_custkey = sensor where sensor % 2 = 1""")
def era_rekey(spark, sf):
    """First eras start at a floor: even customers are coils, one market segment survives."""
    name = F.concat(F.when(F.col("sensor_id").cast("long") % 2 == 0, "C").otherwise("M"), "sensor_id")
    seg = eras(spark, sf).withColumn("sensor_id", name)
    c = F.col("c_custkey")
    survivors = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.concat(F.when(c % 2 == 0, "C").otherwise("M"), c).alias("sensor_id"))
    return catalog.rekey_first_era(seg, survivors, ["C"]).select("sensor_id", "since_shot", "price")


# ---- sets and groups -------------------------------------------------------------------------------
def sensor_sets(spark, sf):
    """Suppliers in nation lists, nations in region composites, one composite of all regions and a cycle."""
    s, n, g = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    dev = F.lit("d").alias("device_id")
    lists = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(dev, F.col("n_name").alias("set_name"), F.lit("list").alias("type"), F.col("s_name").alias("member"), F.col("s_suppkey").cast("int").alias("ord"))
    comp = n.join(g, F.col("n_regionkey") == F.col("r_regionkey")).select(dev, F.col("r_name").alias("set_name"), F.lit("composite").alias("type"), F.col("n_name").alias("member"), F.col("n_nationkey").alias("ord"))
    top = g.select(dev, F.lit("All Bp").alias("set_name"), F.lit("composite").alias("type"), F.col("r_name").alias("member"), F.col("r_regionkey").alias("ord"))
    back = g.select(dev, F.col("r_name").alias("set_name"), F.lit("composite").alias("type"), F.lit("All Bp").alias("member"), F.lit(99).alias("ord"))
    return lists.unionByName(comp).unionByName(top).unionByName(back)


SETS = """st as (select n_name as sname, 'list' as ty, s_name as member, s_suppkey::int as ord from supplier join nation on s_nationkey = n_nationkey
union all select r_name, 'composite', n_name, n_nationkey from nation join region on n_regionkey = r_regionkey
union all select 'All Bp', 'composite', r_name, r_regionkey from region union all select r_name, 'composite', 'All Bp', 99 from region),
walk(root, node, seen) as (select distinct sname, sname, [sname] from st union all
  select w.root, e.member, list_append(w.seen, e.member) from walk w join st e on e.sname = w.node and e.ty = 'composite' where not list_contains(w.seen, e.member)),
fl as (select distinct root as set_name, member from walk join st on st.sname = walk.node and st.ty = 'list')"""


@query("flatten_sets", f"with recursive {SETS} select set_name, member from fl")
def flatten_sets(spark, sf):
    return catalog.flatten_sets(spark, sensor_sets(spark, sf)).select("set_name", "member")


@query("set_summary", f"""with recursive {SETS} select set_name, count(*) as count, case when lower(set_name) like '%coil%' then 'coil' when lower(set_name) like '%bp%' then 'Bp'
  when lower(set_name) like '%br%' or lower(set_name) like '%saddle%' then 'Br' else 'coil' end as kind from fl group by set_name""")
def set_summary(spark, sf):
    return catalog.set_summary(catalog.flatten_sets(spark, sensor_sets(spark, sf))).select("set_name", "count", "kind")


@query("channel_filter", f"""with recursive {SETS}, ch as (select distinct s_name as channel from supplier)
select channel from ch where channel in (select member from fl where set_name in ('All Bp', 'NATION_3') and set_name = 'NATION_3') or regexp_matches(channel, '^(?:Supplier#0000000[1-3])')""")
def channel_filter(spark, sf):
    """A set name spelled with a space and a pattern, together."""
    ch = table(spark, sf, "supplier").select(F.col("s_name").alias("channel"))
    return catalog.channel_filter(ch, ["NATION 3", "Supplier#0000000[1-3]"], catalog.flatten_sets(spark, sensor_sets(spark, sf)))


@query("channel_exclude", "select s_name as channel from supplier where not regexp_matches(s_name, '^(?:Supplier#0000000[1-3])') and not regexp_matches(s_name, '^(?:.*5$)')")
def channel_exclude(spark, sf):
    ch = table(spark, sf, "supplier").select(F.col("s_name").alias("channel"))
    return catalog.exclude(ch, ["Supplier#0000000[1-3]", ".*5$"])


@query("first_set", """with m as (select s_suppkey, n_name, n_nationkey from supplier join nation on s_nationkey = n_nationkey union all select s_suppkey, 'coil ' || r_name, 100 + r_regionkey from supplier, region where s_suppkey % 5 <= r_regionkey)
select s_suppkey::varchar as channel, arg_min(n_name, n_nationkey) as family, case when lower(arg_min(n_name, n_nationkey)) like '%coil%' then 'coil' when lower(arg_min(n_name, n_nationkey)) like '%br%' then 'Br' else 'Bp' end as kind from m group by all""")
def first_set(spark, sf):
    s, n, g = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    base = dict(device_id=F.lit("d"), type=F.lit("list"), ord=F.col("s_suppkey").cast("int"), member=F.col("s_suppkey").cast("string"))
    cols = ["device_id", "set_name", "set_ord", "type", "member", "ord"]
    a = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).withColumns(base).withColumns({"set_name": F.col("n_name"), "set_ord": F.col("n_nationkey")}).select(cols)
    steps = F.sequence((F.col("s_suppkey") % 5).cast("int"), F.lit(4))  # regions are numbered 0..4
    b = s.withColumn("_region", F.explode(steps)).join(g, F.col("_region") == F.col("r_regionkey"))
    b = b.withColumns(base).withColumns({"set_name": F.concat(F.lit("coil "), "r_name"), "set_ord": 100 + F.col("r_regionkey")}).select(cols)
    return catalog.first_set(a.unionByName(b)).select("channel", "family", "kind")


@query("channel_list_dedup", """with g as (select p_type as analysis, p_brand as grp, p_name as pointname, cast(substr(p_brand, 7) as int) as g_ord, p_partkey as s_ord from part)
select analysis, pointname, min((g_ord, s_ord))[1] as g_ord, min((g_ord, s_ord))[2] as s_ord, arg_min(grp, (g_ord, s_ord)) as grp from g group by analysis, pointname""")
def channel_list_dedup(spark, sf):
    """Analyses are part types, their groups brands, pointnames part names; repeated names keep their first place."""
    p = table(spark, sf, "part")
    key = F.concat("p_type", F.lit("|"), "p_brand")
    groups = p.select(F.col("p_type").alias("analysis"), key.alias("group"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("ord")).distinct()
    names = p.select(key.alias("group"), F.col("p_name").alias("pointname"), F.col("p_partkey").alias("ord"))
    d = catalog.signals_for(groups, names)
    return d.select("analysis", "pointname", "g_ord", "s_ord", F.substring_index("group", "|", -1).alias("grp"))


@query("catalog_membership", """with c as (select unnest(['kappa', 'ip', 'bt']) as name), e as (select distinct event_type from events) select event_type, name, rank, tree from e, c,
 (values (0, 'efit01'), (1, 'efit01'), (2, 'efit02'), (3, 'efitrt1')) t(rank, tree) where name = 'kappa'""")
def catalog_membership(spark, sf):
    """Tree candidates of each analysis; analyses are the event types."""
    from ringwave.sources import signal_catalog

    a = table(spark, sf, "events").select(F.col("event_type").alias("analysis")).distinct().withColumn("name", F.explode(F.array(F.lit("kappa"), F.lit("ip"), F.lit("bt"))))
    d = catalog.tree_signals_for(a, signal_catalog.tree_candidates(spark))
    return d.select(F.col("analysis").alias("event_type"), "name", "rank", "tree")


@query("first_usable_source", """select l_orderkey, min(l_linenumber) as rank, arg_min(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as payload from lineitem where l_tax > 0.02 and l_quantity >= 2 group by l_orderkey""")
def first_usable_source(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("rank", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    u = catalog.first_usable(d, ["l_orderkey"], "rank", (F.col("l_tax") > 0.02) & (F.col("l_quantity") >= 2), ["l_extendedprice"])
    return u.select("l_orderkey", F.col("rank.l_linenumber").alias("rank"), F.col("l_extendedprice").alias("payload"))


@query("plasma_entries", """with e as (select event_id, event_type as name, case when event_id % 3 > 0 then 'tree' || (props::json->>'k') end as tree, case when event_id % 3 = 2 then 'node' end as node from events)
select event_id, name, case when tree is null then 0 when node is not null then 1 else 2 end as n, case when tree is null then null when node is not null then node else '\\' || name end as first_node,
  case when tree is not null and node is null then '\\top.results.aeqdsk:' || name end as second_node from e""")
def plasma_entries(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    tree = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("tree"), k))
    node = F.when(F.col("event_id") % 3 == 2, "node")
    entry = F.when(tree.isNull(), F.col("event_type")).otherwise(X.clean_json(F.struct(F.col("event_type").alias("name"), tree.alias("tree"), node.alias("node"))))
    d = catalog.plasma_candidates(e.select("event_id", entry.alias("entry")))
    return d.select("event_id", "name", F.size("candidates").alias("n"), F.get("candidates", F.lit(0))["node"].alias("first_node"), F.get("candidates", F.lit(1))["node"].alias("second_node"))


@query("device_resolution", """select c_custkey, c_mktsegment as device, r_name as device_id from customer left join region on lower(r_name) = lower(case when c_custkey % 2 = 0 then 'Region_' || (c_custkey % 7) else '' end) or (c_custkey % 2 = 1 and c_name = 'Customer#00000000' || r_regionkey)""")
def device_resolution(spark, sf):
    """Even customers quote an id in mixed case, odd ones a display name that mostly matches nothing."""
    c = table(spark, sf, "customer")
    dev = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Region_"), F.col("c_custkey") % 7)).otherwise(F.col("c_name"))
    g = table(spark, sf, "region").select(F.col("r_name").alias("device_id"), F.concat(F.lit("Customer#00000000"), "r_regionkey").alias("name"))
    d = catalog.resolve_device(c.select("c_custkey", "c_mktsegment", dev.alias("device")), g)
    return d.select("c_custkey", F.col("c_mktsegment").alias("device"), "device_id")


@query("loose_names", "select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as loose, replace(trim(c_mktsegment), '_', ' ') as set_key from customer")
def loose_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.loose_name("c_name").alias("loose"), X.set_name_key("c_mktsegment").alias("set_key"))


@query("missing_report", """with c as (select l_suppkey as shot, l_partkey::varchar || '-' || l_orderkey as channel, case when l_returnflag = 'A' then 'fetched' else 'missing' end as status, case when l_returnflag = 'R' then null else l_linestatus end as error from lineitem),
b as (select shot, coalesce(error, 'unknown') as reason, channel, row_number() over (partition by shot, coalesce(error, 'unknown') order by channel) as rn from c where status = 'missing')
select shot, reason, count(*) as n, string_agg(channel, ', ' order by channel) filter (rn <= 12) as names, count(*) > 12 as more from b group by all""")
def missing_report(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("shot"), F.concat(F.col("l_partkey").cast("string"), F.lit("-"), "l_orderkey").alias("channel"),
        F.when(F.col("l_returnflag") == "A", "fetched").otherwise("missing").alias("status"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("error"))
    return catalog.missing_report(d)


# ---- discovery -------------------------------------------------------------------------------------
@query("shot_index", "select user_id // 8 as shot, count(distinct user_id % 8) as n_channels, count(*) as n_samples from events group by all")
def shot_index(spark, sf):
    d = event_samples(spark, sf).groupBy("shot", "channel").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("shot").agg(F.count("channel").alias("n_channels"), F.sum("n").alias("n_samples"))


@query("best_files", "select o_custkey as shot, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as path from orders where o_custkey <> 0 and o_orderstatus <> 'P' group by all")
def best_files(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("shot"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("n_channels"), (F.col("o_orderstatus") != "P").alias("readable"))
    return lake.best_files(o).select("shot", "path")


@query("live_channels", "select l_suppkey as shot, l_partkey as channel from lineitem where l_discount > 0.05 group by all")
def live_channels(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shot"), F.col("l_partkey").alias("channel"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("value"))
    return catalog.live_channels(d)


@query("channel_usage", """with u as (select distinct l_partkey from lineitem where l_quantity > 45 and l_returnflag = 'R'), v as (select distinct l_partkey from lineitem where l_discount > 0.095)
select p_partkey as channel, case when u.l_partkey is not null and v.l_partkey is not null then 'array,pair' when u.l_partkey is not null then 'pair' when v.l_partkey is not null then 'array' else '' end as roles,
  u.l_partkey is not null or v.l_partkey is not null as used from part left join u on u.l_partkey = p_partkey left join v on v.l_partkey = p_partkey""")
def channel_usage(spark, sf):
    l = table(spark, sf, "lineitem")
    one = F.lit(1).alias("shot")
    roles = l.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select(one, F.col("l_partkey").alias("channel"), F.lit("pair").alias("role")).distinct().unionByName(
        l.where(F.col("l_discount") > 0.095).select(one, F.col("l_partkey").alias("channel"), F.lit("array").alias("role")).distinct())
    d = summaries.channel_usage(table(spark, sf, "part").select(one, F.col("p_partkey").alias("channel")), roles)
    return d.select("channel", F.array_join("roles", ",").alias("roles"), "used")


PREF = """cd as (select n_regionkey as shot, case when s_suppkey % 4 = 0 then 0 when s_suppkey % 4 = 1 then 1 else 2 end as pref, s_suppkey as channel, s_suppkey * 37 % 360 as phi from supplier join nation on s_nationkey = n_nationkey)"""


def candidates(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("shot"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 1).otherwise(2).alias("pref"), k.alias("channel"), (k * 37 % 360).alias("phi"))


@query("widest_pair", f"""with {PREF}, g as (select shot, pref, arg_min(channel, (phi, channel)) as ch1, min(phi) as phi1, arg_max(channel, (phi, channel)) as ch2, max(phi) as phi2, count(*) as n_probes from cd group by all),
k as (select *, row_number() over (partition by shot order by pref) as rn from g where phi1 <> phi2) select shot, pref, ch1, phi1, ch2, phi2, n_probes, phi2 - phi1 as delta_phi from k where rn = 1""")
def widest_pair(spark, sf):
    return summaries.widest_pair(candidates(spark, sf))


@query("usable_array", f"""with {PREF}, g as (select shot, pref from cd group by all having count(*) >= 4 and count(distinct phi) >= 4), k as (select shot, min(pref) as pref from g group by shot)
select cd.shot, cd.pref, channel, phi from cd join k on k.shot = cd.shot and k.pref = cd.pref""")
def usable_array(spark, sf):
    return summaries.usable_array(candidates(spark, sf)).select("shot", "pref", "channel", "phi")


@query("family_summary", """select p_brand as device_id, p_type as family, arg_min(p_name, p_partkey) as kind, arg_min(case when p_size > 5 then 'loop' else 'point' end, p_partkey) as shape, count(*) as count, min(p_partkey) as first_seen from part group by all""")
def family_summary(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_brand").alias("device_id"), F.col("p_type").alias("family"), F.col("p_name").alias("kind"), X.sensor_shape("p_size").alias("shape"), F.col("p_partkey").alias("ord"))
    return summaries.family_summary(d)


@query("thin_path", """with n as (select p_brand, count(*) as n from part group by all), p as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) - 1 as ord from part),
t as (select p_brand, cast(floor(j * (n / 20)) as bigint) as ord from n, range(0, 20) s(j) where n > 20 union all select p_brand, n - 1 from n where n > 20)
select p.p_brand, p.p_partkey from p join n using (p_brand) where n <= 20 union all select p.p_brand, p.p_partkey from t join p using (p_brand, ord)""")
def thin_path(spark, sf):
    from ringwave.operators import blocks

    p = blocks.row_index(table(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], F.floor(F.col("p_partkey") / 1000), "ord")
    return summaries.thin_path(p, 20, ["p_brand"]).select("p_brand", "p_partkey")


# ---- scalar geometry ----------------------------------------------------------------------------------
GEO = """g as (select p_partkey, 1 + p_size / 25 as r, (p_retailprice % 100 - 50) / 40 as z, (p_partkey * 13 % 360)::double as phi, (p_partkey * 7 % 180)::double as tilt,
  0.05 + p_size / 1000 as length, (p_partkey % 12)::double as delta_phi, case when p_partkey % 4 = 0 then p_partkey % 720 - 360 end::double as theta,
  case when p_partkey % 3 > 0 then 1 + (p_size % 10) / 10 end as kappa from part)"""


def part_geometry(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey", (1 + s / 25).alias("r"), ((F.col("p_retailprice") % 100 - 50) / 40).alias("z"), (k * 13 % 360).cast("double").alias("phi"), (k * 7 % 180).cast("double").alias("tilt"),
        (0.05 + s / 1000).alias("length"), (k % 12).cast("double").alias("delta_phi"), F.when(k % 4 == 0, (k % 720 - 360).cast("double")).alias("theta"),
        F.when(k % 3 > 0, 1 + (s % 10) / 10).alias("kappa"))


@query("sensor_endpoints", f"""with {GEO}, e as (select *, r - length / 2 * cos(radians(tilt)) as r1, r + length / 2 * cos(radians(tilt)) as r2, z - length / 2 * sin(radians(tilt)) as z1, z + length / 2 * sin(radians(tilt)) as z2 from g)
select p_partkey, round(r1, 6) + 0.0 as r_end1, round(r2, 6) + 0.0 as r_end2, round(z1, 6) + 0.0 as z_end1, round(z2, 6) + 0.0 as z_end2, round(phi - delta_phi / 2, 6) + 0.0 as phi_end1, round(phi + delta_phi / 2, 6) + 0.0 as phi_end2,
  round(degrees(atan2(z1, r1 - 1.69)), 6) + 0.0 as theta_end1, round(degrees(atan2(z2, r2 - 1.69)), 6) + 0.0 as theta_end2, case when delta_phi > 5 then 'loop' else 'point' end as shape from e""")
def sensor_endpoints(spark, sf):
    d = part_geometry(spark, sf)
    return out(d.select("p_partkey", *[c.alias(n) for n, c in X.endpoint_columns(1.69).items()], X.sensor_shape("delta_phi").alias("shape")))


@query("theta_star", f"""with {GEO}, t as (select p_partkey, kappa, coalesce(((theta % 360) + 360) % 360, ((degrees(atan2(z, r - 1.69)) % 360) + 360) % 360) as th from g)
select p_partkey, round(th, 6) + 0.0 as theta, round(case when kappa is null then th else ((degrees(atan2(sin(radians(th)), kappa * cos(radians(th)))) % 360) + 360) % 360 end, 4) + 0.0 as star,
  round(degrees(radians(th) - 0.3 * sin(radians(th)) - 0.1 * sin(2 * radians(th))), 6) + 0.0 as straight, case when kappa between 1 and 4 then round(kappa, 6) + 0.0 end as kappa from t""")
def theta_star(spark, sf):
    d = part_geometry(spark, sf).withColumn("th", X.poloidal_angle("theta", "r", "z", 1.69))
    return out(d.select("p_partkey", F.col("th").alias("theta"), X.theta_star("th", "kappa").alias("star"), X.straight_field_angle("th", 0.3, 0.1).alias("straight"), X.sane_kappa("kappa").alias("kappa")), 6, star=4)


@query("angle_wraps", f"""with {GEO}, a as (select p_partkey, phi * 3 - 500 as x, phi as a, tilt * 2 as b from g)
select p_partkey, round(((x + 180) % 360 + 360) % 360 - 180, 6) + 0.0 as w180, round((x % 360 + 360) % 360, 6) + 0.0 as w360, round(case when b - a > 180 then b - a - 360 when b - a < -180 then b - a + 360 else b - a end, 6) + 0.0 as delta,
  case when greatest(a, b) - least(a, b) > 240 then least(a, b) + 360 else least(a, b) end as low_no_wrap, round(((a + 2 * b) % 360 + 360) % 360, 6) + 0.0 as detrended from a""")
def angle_wraps(spark, sf):
    d = part_geometry(spark, sf).select("p_partkey", (F.col("phi") * 3 - 500).alias("x"), F.col("phi").alias("a"), (F.col("tilt") * 2).alias("b"))
    nw = X.no_wrap(F.array(F.least("a", "b"), F.greatest("a", "b")))
    return out(d.select("p_partkey", X.wrap180("x").alias("w180"), X.wrap360("x").alias("w360"), X.delta_degrees("a", "b").alias("delta"), nw[0].alias("low_no_wrap"), X.remove_toroidal_ramp("a", F.lit(2), "b").alias("detrended")))


@query("name_parsing", """select s_suppkey, case when regexp_extract(s_name, '(\\d+)\\D*$', 1) <> '' then (cast(regexp_extract(s_name, '(\\d+)\\D*$', 1) as bigint) % 360)::double end as phi, cast(regexp_replace('shot_' || s_suppkey, '[^0-9]', '', 'g') as bigint) as shot,
  regexp_extract(n_name, '[A-Za-z]+', 0) as family, case when s_nationkey % 3 = 0 then 'n=' || s_suppkey else 'm/n=' || (s_nationkey % 3) || '/' || s_suppkey end as label,
  case when s_acctbal is null or s_acctbal > 20 then 'bad' when s_acctbal > 10 then 'warn' else 'good' end as quality, case when s_suppkey % 3 = 0 then 'Bp' when s_suppkey % 3 = 1 then 'Br' else 'coil' end as kind
from supplier join nation on s_nationkey = n_nationkey""")
def name_parsing(spark, sf):
    d = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fam = F.element_at(F.array(F.lit("MPIX"), F.lit("ESLD"), F.lit("RLC")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return d.select("s_suppkey", X.phi_from_name("s_name").alias("phi"), X.shot_from_filename(F.concat(F.lit("/data/d1/shot_"), "s_suppkey", F.lit(".h5"))).alias("shot"), X.family_of_name("n_name").alias("family"),
                    X.mode_label("s_suppkey", F.col("s_nationkey") % 3).alias("label"), X.k_quality("s_acctbal").alias("quality"), X.kind_from_prefix(fam).alias("kind"))


@query("cosmetic_theta", """with n as (select s_suppkey, case s_suppkey % 6 when 0 then 'MPID66M020' when 1 then 'MPID67B022' when 2 then 'IU30' when 3 then 'PCIL90' when 4 then 'ISLD5A199' else 'C79' end as name, s_suppkey % 6 as q from supplier)
select s_suppkey, name, case q when 0 then 0 when 1 then 23 when 2 then 60 when 3 then -60 when 4 then 200 else 0 end::double as theta, case q when 0 then 'Bp' when 1 then 'Bp' when 4 then 'Br' else 'coil' end as kind from n""")
def cosmetic_theta(spark, sf):
    names = ["MPID66M020", "MPID67B022", "IU30", "PCIL90", "ISLD5A199", "C79"]
    fams = ["MPID", "MPID", "COILS", "COILS", "ISLD", "COILS"]
    j = (F.col("s_suppkey") % 6 + 1).cast("int")
    d = table(spark, sf, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, names)), j).alias("name"), F.element_at(F.array(*map(F.lit, fams)), j).alias("fam"))
    return d.select("s_suppkey", "name", X.cosmetic_theta("name", "fam").alias("theta"), X.kind_from_family("fam").alias("kind"))


@query("gate_positions", "select event_id, round(floor((100 - exp(ln(100) * (1 - greatest(0, least(1, value / 1000))) + ln(0.5) * greatest(0, least(1, value / 1000)))) * 10 + 0.5) / 10, 1) + 0.0 as pct from events")
def gate_positions(spark, sf):
    return out(table(spark, sf, "events").select("event_id", X.gate_percentile("value").alias("pct")), 1)


@query("list_parameters", """select event_id, (event_id % 7) + (event_id % 5) + (props::json->>'k')::int as total, 3 as n from events""")
def list_parameters(spark, sf):
    """Comma-separated parameters with blanks, built from each event, parsed and summed."""
    text = F.concat_ws(",", (F.col("event_id") % 7).cast("string"), F.concat(F.lit(" "), (F.col("event_id") % 5).cast("string")), F.lit(" "), F.get_json_object("props", "$.k"))
    d = table(spark, sf, "events").select("event_id", X.int_list(text).alias("v"))
    return d.select("event_id", F.aggregate("v", F.lit(0), lambda a, x: a + x).alias("total"), F.size("v").alias("n"))


@query("null_cleaning", """select event_id, case when value > 100 then '{"k":' || (props::json->>'k') || '}' else '{"k":' || (props::json->>'k') || ',"t":"' || event_type || '"}' end as js, case when value > 100 then 1 else 0 end as nans from events""")
def null_cleaning(spark, sf):
    e = table(spark, sf, "events")
    big = F.col("value") > 100
    js = X.clean_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(~big, F.col("event_type")).alias("t")))
    arr = X.nan_array(F.array(F.when(~big, F.col("value")), F.lit(1.0)))
    return e.select("event_id", js.alias("js"), F.size(F.filter(arr, F.isnan)).alias("nans"))


@query("kappa_median", "select user_id // 8 as shot, case when quantile_cont(value / 10, 0.5) between 1 and 4 then round(quantile_cont(value / 10, 0.5), 6) + 0.0 end as kappa from events where user_id % 8 = 3 group by all")
def kappa_median(spark, sf):
    from ringwave.operators import blocks

    d = event_samples(spark, sf).where(F.col("channel") == "c3").withColumn("v", F.col("value") / 10)
    return out(blocks.exact_percentile(d, ["shot"], "v", 0.5, "kappa").withColumn("kappa", X.sane_kappa("kappa")))


# ---- the lake ---------------------------------------------------------------------------------------------------
def filled_lake(spark, sf):
    """A lake of the line-item recordings, written in two batches: the odd probes first, then all others."""
    lake = Lake(spark, f"{checkpoint_dir(spark).rstrip('/')}/lake-{uuid.uuid4().hex}")
    d = cut_lineage(stacked_lines(spark, sf).withColumn("t_ms", F.col("i") / 100).select("shot", "channel", "i", "t_ms", "value"))
    shots = d.select("shot").distinct().selectExpr(
        "shot", "'d' as device_id", "'D' as device", "'rotating' as analysis", "'b' as backend", "'s' as source", "cast(null as double) as tmin",
        "cast(null as double) as tmax", "1 as decimate")
    odd = F.substring("channel", 2, 9).cast("int") % 2 == 1
    lake.ingest(0, d.where(odd), shots)
    lake.ingest(1, d.where(~odd), shots)
    return lake


@query("lake_round_trip", f"with {LI} select shot, channel, i, {r('i / 100')} as t_ms, {r('value::float::double')} as value from li")
def lake_round_trip(spark, sf):
    """All samples of a lake with the times joined back from the time bases."""
    d = filled_lake(spark, sf).samples()
    return out(d.select(F.col("shot").cast("long").alias("shot"), "channel", "i", "t_ms", F.col("value").cast("double").alias("value")))


@query("lake_time_bases", f"""with {LI}, c as (select distinct shot, channel, n, (substr(channel, 2)::int % 2 = 0)::int as batch from li),
b as (select batch, sum(n) as stored from (select distinct batch, n from c) group by batch)
select c.batch, count(*) as channels, count(distinct n) as bases, cast(8 * any_value(stored) as bigint) as time_bytes, cast(8 * (sum(n) - any_value(stored)) as bigint) as saved_bytes
from c join b using (batch) group by c.batch""")
def lake_time_bases(spark, sf):
    """Channels, distinct time vectors and bytes of times per batch."""
    return filled_lake(spark, sf).time_report()


@query("lake_channel_names", f"with {LI} select shot, channel, count(*) as n from li group by all")
def lake_channel_names(spark, sf):
    """Live channels with the samples they hold."""
    d = filled_lake(spark, sf).channels().where(F.col("status") == "fetched")
    return d.select(F.col("shot").cast("long").alias("shot"), "channel", F.col("n").cast("long").alias("n"))
