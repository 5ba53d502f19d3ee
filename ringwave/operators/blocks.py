"""Order-dependent work on long records without putting a whole record into one task.

A window over (shot, channel) would sort a complete record in one task, and one record may
hold a large share of all rows. Everything here therefore works in two levels: rows are grouped
by (keys, block), where a block is a bounded stretch of the record, and only one summary row per
block is ever looked at across blocks.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 14  # samples per block
PIECE = 1 << 17  # numbers a task's Python hands back at once
ROWS = 1 << 20  # rows a task is meant to put in order


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def _on(a: str, b: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return cond


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """Join ``df`` with a table of a few rows per recording (lengths, clocks, angles, fits).

    The small table goes to the rows. Dealt out by recording instead, all rows of one would land in one task,
    and stay there for whatever groups by the recording and more.
    """
    return df.join(F.broadcast(small), on, how)


def deal_out(df: DataFrame, by: Sequence[str], rows: int) -> DataFrame:
    """Deal ``rows`` rows out by ``by`` to more tasks than the session's shuffles have, if these would get over ``ROWS`` each."""
    tasks = -(-rows // ROWS)
    return df.repartition(tasks, *by) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# ---- numbering and running sums ----------------------------------------------------
def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], block: Column, name: str = "i", *, rows: int = 0,
) -> DataFrame:
    """0-based position of each row in its key. ``block`` must be monotone in ``order``.

    With the number of ``rows`` given, a task's share stays the same however many there are.
    """
    keys = list(keys)
    d = df.withColumn("_blk", block)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        deal_out(d, [*keys, "_blk"], rows).withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*keys, "_blk"])
        .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
        .drop("_blk", "_rn", "_off")
    )


def with_previous(df: DataFrame, keys: Sequence[str], idx: str, cols: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Add ``prev_<col>`` of the row with index ``idx - 1``; blocks overlap by one row."""
    keys, blk = list(keys), F.floor(F.col(idx) / block)
    d = df.withColumn(
        "_blk",
        F.explode(F.when(F.col(idx) % block == block - 1, F.array(blk, blk + 1)).otherwise(F.array(blk))),
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(idx)
    for c in cols:
        d = d.withColumn(f"prev_{c}", F.lag(c).over(w))
    return d.where(F.col("_blk") == F.floor(F.col(idx) / block)).drop("_blk")


def running_sum(df: DataFrame, keys: Sequence[str], idx: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Inclusive prefix sum of ``value`` along ``idx``."""
    keys = list(keys)
    d = df.withColumn("_blk", F.floor(F.col(idx) / block))
    inner = Window.partitionBy(*keys, "_blk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_blk").agg(F.sum(value).alias("_s"))
        .select(*keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_off"))
    )
    return (
        d.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
        .join(offsets, [*keys, "_blk"])
        .withColumn(name, F.col("_off") + F.col("_in"))
        .drop("_blk", "_in", "_off")
    )


# ---- nearest known value on either side ---------------------------------------------
def fill_known(
    df: DataFrame, keys: Sequence[str], order: Column, block: Column, value: str,
    *, previous: str | None = None, following: str | None = None,
) -> DataFrame:
    """Add the last known ``value`` at or before each row and/or the first one at or after it.

    ``value`` is NULL where unknown; ``order`` is one comparable column or struct and ``block``
    is monotone in it. Inside a block this is a window, across blocks one carried row per block.
    What follows is looked up backwards: a frame that ends at the last row is read anew for every row.
    """
    keys = list(keys)
    d = df.withColumn("_ord", order).withColumn("_blk", block)
    own, others = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    inner, across = Window.partitionBy(*keys, "_blk"), Window.partitionBy(*keys)
    # only known rows are put in order for the carry; of the others, their blocks alone are needed
    ends = d.where(F.col(value).isNotNull()).groupBy(*keys, "_blk").agg(
        F.max_by(value, "_ord").alias("_last"), F.min_by(value, "_ord").alias("_first")
    )
    carry = d.select(*keys, "_blk").distinct().join(ends, [*keys, "_blk"], "left")
    picks, drops = [], ["_ord", "_blk"]
    if previous:
        carry = carry.withColumn("_before", F.last("_last", True).over(across.orderBy("_blk").rowsBetween(*others)))
        d = d.withColumn("_pin", F.last(value, True).over(inner.orderBy("_ord").rowsBetween(*own)))
        picks.append((previous, F.coalesce("_pin", "_before")))
        drops += ["_pin", "_before"]
    if following:
        carry = carry.withColumn("_after", F.last("_first", True).over(across.orderBy(F.desc("_blk")).rowsBetween(*others)))
        d = d.withColumn("_fin", F.last(value, True).over(inner.orderBy(F.desc("_ord")).rowsBetween(*own)))
        picks.append((following, F.coalesce("_fin", "_after")))
        drops += ["_fin", "_after"]
    out = d.join(carry.drop("_last", "_first"), [*keys, "_blk"])
    for name, expr in picks:
        out = out.withColumn(name, expr)
    return out.drop(*drops)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str,
    payload: Sequence[str], width: float, *, nearest_floor: bool = False,
) -> DataFrame:
    """Latest right row with ``right_on <= left_on`` per key (boundary inclusive).

    ``width`` is the block width in units of the order column. With ``nearest_floor`` a left row
    before the first right row takes that first one.
    """
    keys = list(keys)
    lcols = list(left.columns)
    l = left.select(
        *keys, F.col(left_on).cast("double").alias("_t"), F.lit(1).alias("_tag"),
        F.struct(*lcols).alias("_left"), F.lit(None).cast("double").alias(right_on),
        *[F.lit(None).cast(right.schema[p].dataType).alias(f"_p_{p}") for p in payload],
    )
    r = right.select(
        *keys, F.col(right_on).cast("double").alias("_t"), F.lit(0).alias("_tag"),
        F.lit(None).cast(l.schema["_left"].dataType).alias("_left"),
        F.col(right_on).cast("double").alias(right_on),
        *[F.col(p).alias(f"_p_{p}") for p in payload],
    )
    both = l.unionByName(r).withColumn(
        "_pay", F.when(F.col("_tag") == 0, F.struct(right_on, *[f"_p_{p}" for p in payload]))
    ).drop(right_on, *[f"_p_{p}" for p in payload])
    filled = fill_known(
        both, keys, F.struct("_t", "_tag"), F.floor(F.col("_t") / width), "_pay",
        previous="_prev", following="_next" if nearest_floor else None,
    ).where(F.col("_tag") == 1)
    pick = F.coalesce("_prev", "_next") if nearest_floor else F.col("_prev")
    return filled.withColumn("_pick", pick).select(
        "_left.*", F.col(f"_pick.{right_on}").alias(right_on),
        *[F.col(f"_pick._p_{p}").alias(p) for p in payload],
    )


# ---- exact percentiles ----------------------------------------------------------------
RANGES = 1 << 12


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """Linear-interpolation percentiles per key, exact for groups of any size; NULL and NaN are left out.

    ``wanted`` maps result columns to fractions; all share the same three passes. A mergeable sketch brackets each rank; rows
    are counted in ``RANGES`` equal ranges of the bracket; only values of the ranges that hold the two
    neighbouring ranks are put in order. Every count is combined before it is shuffled, and no window holds more than one
    key's ranges or one range's values.
    """
    keys = list(keys)
    margin = 5.0 / accuracy
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    bounds = [x for p in wanted.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = known.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", bounds, accuracy).alias("_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    small = F.col("_n") < accuracy / 2

    def bracket(j: int, p: float) -> Column:
        low = F.when(small | F.lit(bounds[2 * j] <= 0), F.col("_min")).otherwise(F.col("_b")[2 * j])
        high = F.when(small | F.lit(bounds[2 * j + 1] >= 1), F.col("_max")).otherwise(F.col("_b")[2 * j + 1])
        return F.struct(F.lit(j).alias("j"), (F.lit(p) * (F.col("_n") - 1)).alias("pos"), low.alias("lo"), high.alias("hi"))

    brackets = sketch.select(*keys, F.array(*[bracket(j, p) for j, p in enumerate(wanted.values())]).alias("_items"))
    met = known.join(brackets, keys).select(*keys, "_v", F.explode(F.filter("_items", lambda x: F.col("_v") <= x["hi"])).alias("_x"))
    span = (F.col("_x.hi") - F.col("_x.lo")) / RANGES
    at = F.when(F.col("_v") < F.col("_x.lo"), -1).when(span > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("_v") - F.col("_x.lo")) / span))).otherwise(0)
    counted = met.groupBy(*keys, F.col("_x.j").alias("_j"), F.col("_x.pos").alias("_pos"), at.alias("_at")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_j").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counted.withColumn("_upto", upto).withColumn(
        "_rank", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
    before = F.col("_upto") - F.col("_c")
    held = ranks.where((before <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))).groupBy(*keys).agg(
        F.collect_list(F.struct("_j", "_pos", "_rank", (F.col("_rank") - before).alias("_rest"), "_lo", "_hi")).alias("_held"))
    inside = known.join(held, keys).select(
        *keys, "_v", F.explode(F.filter("_held", lambda x: (x["_lo"] <= F.col("_v")) & (F.col("_v") <= x["_hi"]))).alias("_x"))
    group = [*keys, "_j", "_pos", "_rank", "_rest"]
    values = inside.select(*keys, "_x._j", "_x._pos", "_x._rank", "_x._rest", "_v").groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_j", "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("_upto", upto).where((F.col("_upto") - F.col("_c") <= F.col("_rest")) & (F.col("_rest") < F.col("_upto")))
    frac = F.col("_pos") - F.floor("_pos")
    out = []
    for j, name in enumerate(wanted):
        own = F.col("_j") == j
        low, high = F.max(F.when(own & (F.col("_rank") == F.floor("_pos")), F.col("_v"))), F.max(F.when(own & (F.col("_rank") == F.ceil("_pos")), F.col("_v")))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * F.max(F.when(own, frac))).alias(name))
    return found.groupBy(*keys).agg(*out)


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str, accuracy: int = 10000) -> DataFrame:
    """One of :func:`exact_percentiles`."""
    return exact_percentiles(df, keys, value, {name: p}, accuracy)


# ---- packed blocks for vectorised kernels ----------------------------------------------
def pack(
    df: DataFrame, keys: Sequence[str], idx: str, values: Sequence[str], block, *, left=0, right=0, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per (keys, block): ``i0`` and the ``rows`` of the block plus its halo, in order.

    ``left``/``right`` samples of the neighbours are added to each block, so that filters see no
    seam. Block, halo and index may be columns. Blocks that would hold only halo are dropped.
    ``rows`` holds ``_i``, the values as doubles and the carried columns.
    """
    keys = list(keys)
    i, b = F.col(idx), _col(block)
    first = F.greatest(F.floor((i - _col(right)) / b), F.lit(0))
    last = F.floor((i + _col(left)) / b)
    row = F.struct(i.alias("_i"), *[F.col(v).cast("double").alias(v) for v in values], *[F.col(c) for c in carry if c not in values])
    return (
        df.select(*keys, row.alias("_r"), b.alias("_len"), F.explode(F.sequence(first, last)).alias("blk"))
        .groupBy(*keys, "blk", "_len").agg(F.sort_array(F.collect_list("_r")).alias("rows"))
        .withColumns({"i0": F.col("rows")[0]["_i"], "_edge": F.col("blk") * F.col("_len")})
        .where(F.element_at("rows", -1)["_i"] >= F.col("_edge"))
        .withColumn("start", F.greatest("_edge", "i0"))  # a record may begin inside its first block
        .withColumn("len", F.least(F.col("_edge") + F.col("_len") - F.col("start"), F.col("i0") + F.size("rows") - F.col("start")))
        .drop("_edge", "_len")
    )


def filtered(
    df: DataFrame, keys: Sequence[str], idx: str, values: dict[str, str], taps_for, edge: str, *,
    param=0.0, before=0, after=0, block: int = BLOCK, carry: Sequence[str] = (),
) -> DataFrame:
    """Apply a FIR kernel along ``idx``: ``out[i] = sum_j taps[j] * value[i + j - before]``.

    ``values`` maps output names to input columns. ``taps_for`` maps ``param`` (a number or a column
    constant per key) to ``before + 1 + after`` taps. ``edge`` is ``first`` (hold the first value, for
    causal kernels) or ``reflect`` (half-sample mirror). ``carry`` columns travel inside the packed
    rows, so the result needs no join back. Returns keys, idx, the carried columns and the outputs.
    """
    keys, ins = list(keys), list(dict.fromkeys(values.values()))
    mode = "edge" if edge == "first" else "symmetric"
    b, a = _col(before).cast("long"), _col(after).cast("long")
    halo = F.greatest(b, a) if edge == "reflect" else b

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache = {}
        for batch in batches:
            res, held = [], 0
            for columns, first, s, own, q, nb, na in zip(*batch):
                if q not in cache:
                    cache[q] = np.asarray(taps_for(q), dtype=float)
                lead = int(s - first)  # halo samples in front of the block
                done = []
                for v in columns:
                    v = np.asarray(v, dtype=float)
                    ext = np.pad(v, (max(0, nb - lead), max(0, na - (len(v) - lead - own))), mode=mode)
                    off = max(lead, nb) - nb
                    done.append(np.correlate(ext[off: off + own + nb + na], cache[q], mode="valid"))
                    held += len(done[-1])
                res.append(done)
                if held >= PIECE:
                    yield pd.Series(res)
                    res, held = [], 0
            if res:
                yield pd.Series(res)

    more = [c for c in carry if c not in (*keys, idx)]
    d = df.select(*keys, idx, *dict.fromkeys([*ins, *more]), _col(param).cast("double").alias("_q"), b.alias("_b"), a.alias("_a"), halo.alias("_halo"))
    group = [*keys, "_q", "_b", "_a", "_halo"]
    packed = pack(d, group, idx, ins, F.greatest(F.lit(block).cast("long"), F.col("_halo") + 1), left="_halo",
                  right="_halo" if edge == "reflect" else "_a", carry=more)
    once = run.asNondeterministic()  # or a filter on the outputs would be pushed below it and filter all blocks again
    y = once(F.array(*[F.col(f"rows.{c}") for c in ins]), "i0", "start", "len", "_q", "_b", "_a")
    done = packed.select(*keys, F.slice("rows", (F.col("start") - F.col("i0") + 1).cast("int"), F.col("len").cast("int")).alias("_r"), y.alias("_y"))
    cols = {idx: F.col("_r._i"), **{c: F.col(f"_r.{c}") for c in more}, **{o: F.col("_y")[ins.index(c)] for o, c in values.items()}}
    return done.select(*keys, F.inline(F.arrays_zip(*[e.alias(n) for n, e in cols.items()])))
