"""Live feeds: sliding spectra, mode numbers, causal filters with carried state, idempotent ingest."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringwave.operators import blocks, condition, modes, spectra
from ringwave.sources.lake import REDUCTION, Lake


def sliding_spectra(stream: DataFrame, *, n_fft: int, rate: float, ks: Sequence[int], late: str, hop: int | None = None) -> DataFrame:
    """Spectrum of each event-time window: one watermarked aggregation, append mode.

    ``stream`` has shot, channel, ts, value. A window holds ``n_fft`` samples at ``rate`` and slides by
    half of that; rows later than the watermark are dropped. Windows are aligned to the epoch. Every window that
    got a sample gives its rows once: ``n_samples`` are the samples it got, and where some are missing
    or came twice it is not ``complete`` and ``re``, ``im`` are null.
    """
    step = n_fft // 2 if hop is None else hop
    micros = 1e6 / rate
    w = F.window("ts", f"{round(n_fft * micros)} microseconds", f"{round(step * micros)} microseconds")
    d = stream.withWatermark("ts", late).select("shot", "channel", "value", "ts", w.alias("w"))
    j = F.rint((F.unix_micros("ts") - F.unix_micros("w.start")) / micros).cast("long")
    sums = d.groupBy("w", "shot", "channel").agg(
        *spectra.twiddle_sums(j, F.col("value").cast("double"), n_fft, ks), F.sum(j).alias("_j"), F.sum(j * j).alias("_jj"))
    # a missing sample and a repeated one may keep the count, not the sums of positions too
    complete = (F.col("_cnt") == n_fft) & (F.col("_j") == n_fft * (n_fft - 1) // 2) & (F.col("_jj") == (n_fft - 1) * n_fft * (2 * n_fft - 1) // 6)
    rows = sums.select("shot", "channel", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("_cnt").alias("n_samples"),
                       complete.alias("complete"), F.inline(spectra.twiddle_rows(ks)))
    return rows.withColumns({c: F.when(F.col("complete"), F.col(c)) for c in ("re", "im")})


def live_mode_numbers(spectra_stream: DataFrame, angles: DataFrame, sink, n_max: int = 5):
    """Start a query that passes each complete window's mode map to ``sink(df, batch_id)``."""

    def per_batch(df: DataFrame, batch_id: int) -> None:
        sink(modes.mode_map(df.where("complete"), angles, n_max, keys=("shot", "start", "k")), batch_id)

    return spectra_stream.writeStream.outputMode("append").foreachBatch(per_batch)


FILTER_STATE = "tail array<double>, next long, at array<long>, waiting array<double>"


def causal_filter(stream: DataFrame, sigma: float, *, first: int = 0, reorder: int = 1 << 14, idle: str | None = None) -> DataFrame:
    """Causal Gaussian on a feed whose rows may come in any order.

    ``stream``: shot, channel, i, value. The state of a channel is the tail of one kernel length, the index that comes next, and
    rows that came before their turn, at most ``reorder`` of them. Rows are given out in order of ``i`` from ``first``
    on; rows that were given out before are dropped. Where more than ``reorder`` rows wait, the missing ones are
    taken as lost: the filter starts anew behind the gap and ``after_gap`` marks the rows up to the next kernel length. With
    ``idle`` (a duration such as "10 minutes") a channel without rows for so long gives out what waits and its state goes.
    """
    taps = condition.causal_taps(sigma)
    reach = len(taps) - 1
    idle_ms = pd.Timedelta(idle) // pd.Timedelta(1, "ms") if idle else None

    def runs(at: np.ndarray) -> list[np.ndarray]:
        return np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, following, held_at, held = state.get if state.exists else ([], first, [], [])
        rows = pd.concat([pd.DataFrame({"i": held_at, "value": held}), *(f[["i", "value"]] for f in frames)])
        rows = rows.drop_duplicates("i").sort_values("i")
        rows = rows[rows["i"] >= following]
        at, v = rows["i"].to_numpy(dtype=np.int64), rows["value"].to_numpy(dtype=float)
        tail, out, used = np.asarray(tail, dtype=float), [], 0
        for run in runs(at) if len(at) else []:
            gap = at[run[0]] != following
            if gap and not state.hasTimedOut and len(at) - run[0] <= reorder:
                break
            if gap or not len(tail):
                tail = np.full(reach, v[run[0]])
            ext = np.concatenate([tail, v[run]])
            fresh = np.arange(len(run)) < reach
            out.append(pd.DataFrame({"shot": key[0], "channel": key[1], "i": at[run], "value": np.correlate(ext, taps, mode="valid"),
                                     "after_gap": fresh if gap else np.zeros(len(run), bool)}))
            tail, following, used = ext[len(ext) - reach :], int(at[run[-1]]) + 1, int(run[-1]) + 1
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((tail.tolist(), following, at[used:].tolist(), v[used:].tolist()))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield from out

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("shot", "channel").applyInPandasWithState(
        step, "shot long, channel string, i long, value double, after_gap boolean", FILTER_STATE, "append", timeout)


def ingest_stream(stream: DataFrame, lake: Lake, shots_of, checkpoint: str):
    """Write each micro-batch as one lake batch; a replayed batch overwrites itself.

    Samples whose index an earlier batch of the same window and decimation holds are skipped. What is held is a
    set of intervals, so files may come in any order and a channel may go on from batch to batch.
    """

    def per_batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            shots = shots_of(df)
            new = df
            if batch_id > 0 and lake.exists():
                same = lake.shots().select("shot", *REDUCTION).intersect(shots.select("shot", *REDUCTION)).select("shot")
                held = lake.held().where(F.col("batch") < batch_id).join(same, "shot", "left_semi").select(
                    "shot", "channel", "blk", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).alias("h")
                d = df.withColumn("blk", F.floor(F.col("i") / blocks.BLOCK)).alias("d")
                same_block = [F.col(f"d.{c}") == F.col(f"h.{c}") for c in ("shot", "channel", "blk")]
                new = d.join(held, [*same_block, F.col("d.i").between(F.col("h._lo"), F.col("h._hi"))], "left_anti").drop("blk")
            if new.limit(1).collect():
                lake.ingest(batch_id, new, shots)
        finally:
            df.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(per_batch)
