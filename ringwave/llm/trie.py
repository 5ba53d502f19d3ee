"""The prefix trie of conversations, rolled up in depth bands.

A node is a distinct sequence of first turns; it is told by its smallest conversation and its depth. Prefixes
are identified by two running XORs of position-dependent 64-bit hashes of their turns, taken in blocks of
positions with one value per block carried on, so one conversation may hold any share of the rows.

Sums over subtrees: depths are cut into bands of ``height``. Every node explodes to its ancestors within its band
only, which gives sums within bands; the sums at the tops of bands go up a smaller trie made of band tops alone, by the
same two steps; then each top's completed sum is added to its at most ``height`` ancestors in the band
above. So a trie of depth D needs about log D / log ``height`` rounds and no node explodes to more than
``height`` rows.

Defined results: rows without a conversation id belong to none and are left out; turns come by number, null
first, equal ones by role and text; a null role or text is empty; equal rows are turns each; further columns
are not read; a conversation without turns is a member of the root only; texts of any length count by
code points; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.operators.blocks import row_index
from ringwave.session import cut_lineage

#: Ids that make one piece of a digest's input at most.
PIECE = 1 << 12
#: The id of the empty sequence.
ROOT = "0:0"


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  block_turns: int = 1024) -> DataFrame:
    """``conv, pos, role, text``: positions from 0 in each conversation."""
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(2**62)))
    return row_index(turns, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], block, "pos").select("conv", "pos", "role", "text")


def rebuilt_turns(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """``conv, depth, role, text``: each conversation's first h turns replaced by those of its group's first one.

    h is the CRC-32 of the decimal id modulo ``most``. Only the first turns of the groups' first conversations travel, ``most - 1``
    rows each. A conversation left without turns has one row of depth 0.
    """
    base = F.col("conv") - F.col("conv") % group
    h = F.crc32(F.col("conv").cast("string")) % most
    heads = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("head"))
    heads = cut_lineage(heads)
    met = turns.withColumns({"base": base, "h": h}).join(heads.select("base", F.size("head").alias("n_head")), "base", "left")
    shift = F.least("h", F.coalesce("n_head", F.lit(0))) - F.col("h")
    own = met.where("pos >= h").select("conv", (F.col("pos") + shift + 1).alias("depth"), "role", "text")
    ids = turns.where("pos = 0").select("conv", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    given = ids.select("conv", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select(
        "conv", (F.col("t.pos") + 1).alias("depth"), "t.role", "t.text")
    bare = ids.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return own.unionByName(given).unionByName(bare)


def paths(turns: DataFrame, block: int = 1024) -> DataFrame:
    """``conv, depth, id, n_text, ends``: each conversation's way down the trie from the root, ``ROOT``, at depth 0."""
    told = F.col("depth") > 0
    d = turns.select(
        "conv", "depth", F.when(told, F.xxhash64("depth", "role", "text")).otherwise(0).alias("x"),
        F.when(told, F.xxhash64("text", "role", F.lit("."), "depth")).otherwise(0).alias("y"), F.char_length("text").cast("long").alias("n_text"),
        F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / block).alias("block"))
    sums = d.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max("depth").alias("last"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        "conv", "block", F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("by"),
        F.max("last").over(W.partitionBy("conv")).alias("last"))
    inner = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({"x": F.bit_xor("x").over(inner), "y": F.bit_xor("y").over(inner)}).join(carried, ["conv", "block"])
    ident = F.concat(F.hex(F.col("x").bitwiseXOR(F.col("bx"))), F.lit(":"), F.hex(F.col("y").bitwiseXOR(F.col("by"))))
    return d.select("conv", "depth", ident.alias("id"), "n_text", (F.col("depth") == F.col("last")).alias("ends"))


def with_above(nodes: DataFrame, way: DataFrame, height: int) -> DataFrame:
    """Add ``above``: a node's ancestors in its band, from the band's top down; for a band's top all nodes of the band above.

    ``way`` holds ``conv, pos, id`` of every conversation; a node is found on the way of its own conversation.
    """
    band = F.floor((F.col("pos") - 1) / height)
    bands = way.groupBy("conv", band.alias("band")).agg(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"].alias("ids"))
    rank = ((F.col("pos") - 1) % height).cast("int")
    met = nodes.withColumn("band", band - F.when(rank == 0, 1).otherwise(0)).join(bands, ["conv", "band"], "left")
    above = F.when(rank == 0, F.col("ids")).otherwise(F.slice("ids", F.lit(1), rank))
    return met.withColumn("above", F.coalesce(above, F.array().cast("array<string>"))).drop("band", "ids")


def subtree_sums(nodes: DataFrame, way: DataFrame, values: list[str], height: int, deepest: int) -> DataFrame:
    """``id`` and the sums of ``values`` over each node's subtree; ``nodes`` holds ``id, conv, pos, above`` and the values."""
    top = (F.col("pos") - 1) % height == 0
    to = F.when(top, F.array("id")).otherwise(F.concat("above", F.array("id")))
    sums = [F.sum(v).alias(v) for v in values]
    within = nodes.select(F.explode(to).alias("id"), *values).groupBy("id").agg(*sums)
    if deepest <= height:
        return within
    within = cut_lineage(within)
    place = (F.floor((F.col("pos") - 1) / height) + 1).alias("pos")
    tops = nodes.where(top).select("id", "conv", place).join(within, "id")
    tops_way = way.where(top).select("conv", place, "id")
    done = cut_lineage(subtree_sums(with_above(tops, tops_way, height), tops_way, values, height, -(-deepest // height)))
    down = nodes.where(top).select("id", "above").join(done, "id").select(F.explode("above").alias("id"), *values)
    return within.unionByName(down).groupBy("id").agg(*sums)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come in order; only the running digest of one node is kept."""
    at, digest, rows = None, None, []
    for batch in batches:
        for node, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            if node != at:
                if digest:
                    rows.append((at, digest.hexdigest()))
                at, digest = node, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "ends_sha256"])
            rows = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["id", "ends_sha256"])


def end_digests(way: DataFrame) -> DataFrame:
    """``id, ends_sha256``: the digest of the ids that end at a node, in pieces made in parallel and read in order."""
    pieces = way.where("ends").groupBy("id", F.floor(F.col("conv") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    return pieces.repartition("id").sortWithinPartitions("id", "piece").select("id", "text").mapInArrow(_digests, "id string, ends_sha256 string")


def prefix_trie(turns: DataFrame, height: int = 16) -> DataFrame:
    """One row per node; ``turns`` holds ``conv, depth, role, text``, a row of depth 0 for every conversation included."""
    way = cut_lineage(paths(turns))
    nodes = cut_lineage(way.groupBy("id").agg(
        F.min("conv").alias("conv"), F.first("depth").alias("pos"), F.first("n_text").alias("n_text"), F.count("*").alias("n_convs")))
    deepest, first = nodes.agg(F.max("pos"), F.min("conv")).first()
    inner = with_above(nodes.where("pos > 0"), way.where("depth > 0").select("conv", F.col("depth").alias("pos"), "id"), height)
    inner = inner.withColumn("up", F.when(F.col("pos") == 1, ROOT).otherwise(F.get("above", F.size("above") - 1)))
    inner = cut_lineage(inner)
    children = inner.groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    inner = cut_lineage(inner.join(children, "id", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_text")}))
    way_down = way.where("depth > 0").select("conv", F.col("depth").alias("pos"), "id")
    sums = subtree_sums(
        inner.select("id", "conv", "pos", "above", "n_leaves", "saved_tokens"), way_down, ["n_leaves", "saved_tokens"], height, deepest or 0)
    inner = cut_lineage(inner.drop("above", "n_leaves", "saved_tokens").join(sums, "id"))
    parents = inner.select(F.col("id").alias("up"), F.col("conv").alias("parent_conv_id"))
    deep = inner.where("pos > 1").join(parents, "up")
    shallow = inner.where("pos = 1").withColumn("parent_conv_id", F.lit(first).cast("long"))
    under = inner.where("pos = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = nodes.where("pos = 0").crossJoin(F.broadcast(under)).withColumns({
        "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved_tokens": F.coalesce("saved_tokens", F.lit(0)), "parent_conv_id": F.lit(None).cast("long")})
    names = ["id", "conv", "pos", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = deep.select(names).unionByName(shallow.select(names)).unionByName(root.select(names))
    return every.join(end_digests(way), "id", "left").select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("n_leaves").cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: CRC-32 of the decimal id, digit by digit through the table of the polynomial 0xEDB88320.
TRIE_SQL = r"""with crc as (
  select list(list_reduce(list_prepend(i, range(0, 8)), lambda c, j: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(0, 256) r(i)),
turns as (
  select conv_id as conv, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
ids as (
  select conv, conv - conv % 100 as base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv as varchar), ''), lambda d: cast(ascii(d) as bigint))),
           lambda c, d: xor(c >> 8, t[cast(xor(c, d) & 255 as int) + 1])), 4294967295) % 6 as h
  from (select distinct conv from turns), crc),
heads as (select conv as base, count(*) as n_head from turns where pos < 5 and conv % 100 = 0 group by conv),
way as (
  select conv, 0 as depth, '' as role, '' as text from ids
  union all select ids.conv, pos + 1, role, text from ids join turns on turns.conv = ids.base and pos < h
  union all select t.conv, pos - h + least(h, coalesce(n_head, 0)) + 1, role, text
    from turns t join ids on ids.conv = t.conv and pos >= h left join heads using (base)),
steps as (
  select conv, depth, length(text) as n_text, max(depth) over (partition by conv) as last,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over (partition by conv order by depth) as path from way),
nodes as (
  select depth, path, min(conv) as node, count(*) as n_convs, max(n_text) as n_text,
         string_agg(case when depth = last then cast(conv as varchar) end, ',' order by conv) as ends from steps group by depth, path),
placed as (select steps.conv, steps.depth, node from steps join nodes using (depth, path)),
edges as (select n.*, p.node as parent from nodes n left join placed p on p.conv = n.node and p.depth = n.depth - 1),
kids as (select parent as node, depth - 1 as depth, count(*) as n_children from edges where depth > 0 group by all),
own as (select e.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * n_text as saved from edges e left join kids using (node, depth)),
sums as (
  select p.node, p.depth, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum(o.saved) as saved
  from own o join placed p on p.conv = o.node and p.depth <= o.depth group by all)
select o.node as conv_id, cast(o.depth as bigint) as depth, o.parent as parent_conv_id, n_convs, n_children, cast(n_leaves as bigint) as n_leaves,
       cast(s.saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from own o join sums s on s.node = o.node and s.depth = o.depth"""


@query("op13_trie", sql=TRIE_SQL)
def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_turns(cut_lineage(ordered_turns(table(spark, sf_dir, "conversations")))))
