"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. A document's expected number of copies is proportional to the bits of its
size (longer documents are repeated before short ones), at most ``most`` copies, and scaled so that a source's
expected words are its target. The whole part of the expectation is certain: so many copies are taken. The
fraction is an inclusion probability: documents are ranked by u / (1 - u) over p / (1 - p) with u drawn from a
digest of id and text, and the first in rank are taken until the sample has the words that the target leaves.
The document at that border gives only its first words, so the words of a source are fixed, not just expected.

The border is found by narrowing: the rank is an integer of 48 bits, words are summed in 4,096 ranges of it, then in
4,096 ranges of the one that holds the border, and only rows of that last range are ordered. So one source
may hold any share of all rows. Sources are numbered and targets reshared as a distributed table too.

Defined results: a null text is of size 0 and nothing of it is taken; a null source is a source of its own
and comes last; a null id is drawn like any other; equal rows are documents each and stand side by side in rank;
further columns pass through ``mixed_texts`` and are not read by the plan; an empty table gives no rows; sources without
words have target 0. Reruns agree: nothing depends on the order of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ringwave.llm.registry import query, table
from ringwave.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the digest that make u: 48 bits.
DIGITS, UNIT = 12, 1 << 48
#: Ranges of the rank that words are summed in, twice.
RANGES = 1 << 12


def digest_of(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """``key, doc_id, source, size, bits, u``: what the plan needs of a document."""
    digest = digest_of(id_col, text_col, seed)
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    # the middle of one of 2**48 equal steps, so neither 0 nor 1
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / UNIT
    rows = docs.select(
        digest.alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), u.alias("u"))
    return rows.withColumn("bits", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with ``place`` 0, 1, ... by code point, null last: places in sorted parts plus the parts' sizes."""
    ordered = cut_lineage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    sums = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    return ordered.withColumn("part", part).join(F.broadcast(before), "part").select(
        "source", "source_size", (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """``source, source_size, target``: weights in turn share all words; what passes ``most`` times a size is reshared.

    Each round is one sum over the open sources; only two numbers come to the driver.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut_lineage(numbered(sources).withColumn("weight", weight))
    limit = F.col("source_size") * most
    rest = rows.agg(F.sum("source_size")).first()[0] or 0
    rest, level = rest * share, 0.0
    seen = -1
    while True:
        open_ = limit > F.col("weight") * level if seen >= 0 else F.lit(True)
        at = rows.agg(F.sum(F.when(open_, F.col("weight"))), F.sum(F.when(~open_, limit)), F.count_if(~open_)).first()
        if not at[0] or at[2] == seen:
            break
        seen, level = at[2], (rest - (at[1] or 0)) / at[0]
    return rows.select("source", "source_size", F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def expectations(classes: DataFrame, most: int = 3) -> DataFrame:
    """``source, bits, copies, p, left``: certain copies and inclusion probability of each class of sizes, and the words left to sample.

    A source has at most 63 classes, so the windows here are small. The scale is that of the largest number of
    open classes for which none of them passes ``most``.
    """
    by = W.partitionBy("source")
    up = by.orderBy("bits").rowsBetween(W.unboundedPreceding, 0)
    down = by.orderBy(F.desc("bits")).rowsBetween(W.unboundedPreceding, -1)
    goal = F.round("target").cast("long")
    rows = classes.where("bits > 0").withColumns({
        "goal": goal,
        "scale": (goal - most * F.coalesce(F.sum("words").over(down), F.lit(0))) / F.sum(F.col("bits") * F.col("words")).over(up)})
    # a hair's breadth for rounding where a class just reaches the limit
    fits = (F.col("scale") >= 0) & (F.col("scale") * F.col("bits") <= most * (1 + 1e-12))
    expected = F.coalesce(F.least(F.lit(float(most)), F.max(F.when(fits, F.col("scale"))).over(by) * F.col("bits")), F.lit(float(most)))
    rows = rows.withColumn("expected", expected).withColumn("copies", F.floor("expected"))
    return rows.withColumns({
        "p": F.col("expected") - F.col("copies"), "left": F.col("goal") - F.sum(F.col("copies") * F.col("words")).over(by)}).select(
        F.col("source").alias("_source"), F.col("bits").alias("_bits"), "copies", "p", "left", "source_size", "target")


def odds(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds."""
    return (u * (1 - p)) / ((1 - u) * p)


def allocate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, seed: str = "mix") -> DataFrame:
    """``key, doc_id, source, size, source_size, target, copies, taken``: whole copies of each document and all words taken of it.

    ``share`` is the mix's size as a part of all words; ``taken - copies * size`` is what the sample adds:
    ``size``, 0, or less than ``size`` at a source's border. ``key`` is the digest of id and text.
    """
    rows = cut_lineage(sizes(docs, id_col, text_col, source_col, seed))
    classes = cut_lineage(rows.groupBy("source", "bits").agg(F.sum("size").alias("words")))
    goals = cut_lineage(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most))
    wanted = classes.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    nothing = goals.select(
        F.col("source").alias("_source"), F.lit(0).alias("_bits"), F.lit(0).cast("long").alias("copies"), F.lit(0.0).alias("p"),
        F.lit(0).cast("long").alias("left"), "source_size", "target")
    plan = cut_lineage(expectations(wanted, most).unionByName(nothing))
    ranked = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bits") == F.col("_bits"))).drop("_source", "_bits")
    rank = F.when((F.col("p") > 0) & (F.col("size") > 0), odds(F.col("u"), F.col("p")))
    # q / (1 + q) rises with q and lies in 0 to 1
    step = F.least(F.floor(rank / (1 + rank) * (RANGES * RANGES)), F.lit(RANGES * RANGES - 1))
    ranked = ranked.withColumns({"rank": rank, "coarse": F.floor(step / RANGES), "fine": step % RANGES})
    ranked = _with_border(ranked, ranked.where("rank is not null"), ["source"], "coarse", "left")
    ranked = _with_border(ranked, ranked.where("coarse = at_coarse"), ["source", "coarse"], "fine", "left_coarse")
    at_border = F.coalesce((F.col("coarse") == F.col("at_coarse")) & (F.col("fine") == F.col("at_fine")), F.lit(False))
    in_order = W.partitionBy("source", "coarse", "fine").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    last = ranked.where(at_border).withColumn("before", F.sum("size").over(in_order) - F.col("size"))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left_fine") - F.col("before")))).drop("before")
    inside = (F.col("coarse") < F.col("at_coarse")) | ((F.col("coarse") == F.col("at_coarse")) & (F.col("fine") < F.col("at_fine")))
    rest = ranked.where(~at_border).withColumn("extra", F.when(inside, F.col("size")).otherwise(0))
    return last.unionByName(rest).select(
        "key", "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def _with_border(ranked: DataFrame, rows: DataFrame, keys: list[str], level: str, goal: str) -> DataFrame:
    """Add ``at_<level>``, the range of each group in which its ``goal`` of words is reached, and ``left_<level>``, what is left at its start.

    Where the group has too few words, the border lies behind all ranges.
    """
    sums = rows.groupBy(*keys, level).agg(F.sum("size").alias("n"), F.max(goal).alias("goal"))
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy(level).rowsBetween(W.unboundedPreceding, 0))
    hit = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct(F.col(level).alias("at"), (F.col("goal") - F.col("upto") + F.col("n")).alias("left"))))
    border = sums.withColumn("upto", upto).groupBy(*keys).agg(hit.alias("hit")).select(
        *(F.col(k).alias(f"_{k}") for k in keys),
        F.coalesce("hit.at", F.lit(RANGES)).alias(f"at_{level}"), F.coalesce("hit.left", F.lit(0)).alias(f"left_{level}"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return ranked.join(cut_lineage(border), same, "left").drop(*(f"_{k}" for k in keys))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row a copy; a border document's last copy ends after its first words."""
    plan = allocate(docs, id_col, text_col, source_col, seed=seed, **options)
    nth = F.row_number().over(W.partitionBy("_key").orderBy("_key"))
    plan = plan.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("taken").alias("_taken")).withColumn("_nth", nth)
    rows = docs.withColumn("_key", digest_of(id_col, text_col, seed)).withColumn("_nth", nth)
    rows = rows.join(plan.where("_taken > 0"), ["_key", "_nth"])
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))))
    words = F.least("_size", F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), F.lit(1)), 1, words.cast("int")), " ")
    return rows.withColumn(text_col, F.when(words < F.col("_size"), head).otherwise(F.col(text_col))).select(docs.columns)


MIX_SQL = r"""with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+')) as size,
         (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 12) as bigint) + 0.5)
           / 281474976710656.0::double as u
  from documents),
e as (select *, case when size > 0 then length(bin(size)) else 0 end as bits from d),
s as (select source, cast(sum(size) as bigint) as source_size,
             1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from e group by source),
o as (select *, cast(coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0) as double) as closed,
             cast(sum(weight) over (w rows between current row and unbounded following) as double) as open,
             row_number() over w as place, cast(sum(source_size) over () as double) as total
      from s window w as (order by source_size / weight, source nulls last)),
v as (select max(level) as level from (
        select (total - closed) / open as level, place from o where 3 * source_size > weight * ((total - closed) / open)
        order by place limit 1)),
t as (select source, source_size,
             least(cast(3 * source_size as double), coalesce(weight * (select level from v), 3 * source_size)) as target from s),
c as (select source, bits, cast(sum(size) as bigint) as words from e where bits > 0 group by source, bits),
g as (select c.*, source_size, target, cast(round(target) as bigint) as goal from c join t on c.source is not distinct from t.source),
h as (select *, cast(goal - 3 * coalesce(sum(words) over (w rows between 1 following and unbounded following), 0) as double)
               / cast(sum(bits * words) over (w rows between unbounded preceding and current row) as double) as scale
      from g window w as (partition by source order by bits)),
x as (select *, coalesce(least(3.0::double, max(case when scale >= 0 and scale * bits <= 3 * (1 + 1e-12::double) then scale end)
               over (partition by source) * bits), 3.0::double) as expected from h),
y as (select *, cast(floor(expected) as bigint) as copies, expected - floor(expected) as p from x),
z as (select *, goal - cast(sum(copies * words) over (partition by source) as bigint) as rest from y),
q as (select e.doc_id, e.source, e.size, e.bits, z.copies, z.rest, t.source_size, t.target,
             case when p > 0 and size > 0 then (u * (1 - p)) / ((1 - u) * p) end as rank
      from e join t on e.source is not distinct from t.source
      left join z on e.source is not distinct from z.source and e.bits = z.bits),
r as (select *, sum(case when rank is not null then size end) over (
               partition by source order by rank nulls last, doc_id, size rows between unbounded preceding and current row) - size as before from q)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(coalesce(copies, 0) * size + case when rank is null then 0 else greatest(0, least(size, rest - before)) end as bigint) as taken
from r"""


@query("op11_mixing", sql=MIX_SQL)
def op11_mixing(spark, sf_dir: str) -> DataFrame:
    return allocate(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
