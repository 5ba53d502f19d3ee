"""The recording lake: append-only Parquet batches with a catalog that says which batch is live.

Times are stored apart from samples: every distinct time vector of a batch once, under the hash of its content; a
channel's row names the vector, and readers of times join it back. Which indices a batch holds is kept as intervals, so
batches may arrive in any order.

Every ingest writes its own batch folder, so a repeated or half-finished batch simply overwrites
itself and readers never see a partial channel. A re-fetched channel supersedes its older batch; a
batch with a different window or decimation supersedes the whole recording.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwave.operators import blocks

REDUCTION = ("tmin", "tmax", "decimate")


# ---- degenerate channels ---------------------------------------------------------------
def channel_status(samples: DataFrame, keys: Sequence[str] = ("shot", "channel"), t: str = "t_ms", *, min_points: int = 1, increasing: bool = False) -> DataFrame:
    """Usable or missing per channel, with the reason.

    On write any non-finite or absent time makes a channel unusable; on read (``min_points`` 2,
    ``increasing``) so do a single point and an axis whose end is not after its start. So do times
    without values or values without times, and a single sample of zero.
    """
    time = F.col(t).cast("double")
    bad = time.isNull() | F.isnan(time) | (F.abs(time) == float("inf"))
    first, last = F.min_by(time, "i"), F.max_by(time, "i")
    d = samples.groupBy(*keys).agg(
        F.count(time).alias("n"), F.bool_or(bad).alias("_bad"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("_rows"),
        first.alias("_a"), last.alias("_b"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.max(F.abs("value")).alias("_size"))
    error = (
        F.when((F.col("n") == 0) | F.col("_bad"), "no usable time axis")
        .when(F.col("n") != F.col("n_values"), F.format_string("%d times for %d values", "n", "n_values"))
        .when((F.col("_rows") == 1) & (F.col("_size") == 0), "a lone zero stands for no data")
        .when(F.col("n") < min_points, F.concat(F.lit("degenerate (n="), F.col("n"), F.lit(")")))
    )
    if increasing:
        error = error.when(~(F.col("_b") > F.col("_a")), "degenerate time axis")
    return d.select(*keys, "n", F.when(error.isNull(), "fetched").otherwise("missing").alias("status"), error.alias("error"), "first_i", "last_i")


def time_base_hash(samples: DataFrame, keys: Sequence[str] = ("shot", "channel"), t: str = "t_ms") -> DataFrame:
    """Content hash of each channel's times with their indices, hashed block by block and then over the block hashes."""
    keys = list(keys)
    block = F.floor(F.col("i") / blocks.BLOCK)
    per = samples.groupBy(*keys, block.alias("_b")).agg(
        F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("i", F.col(t).alias("t")))), lambda x: F.concat_ws(":", x["i"].cast("string"), x["t"].cast("string")))), 256).alias("h"))
    return per.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"])), 256).alias("tb_id"))


def time_bases(samples: DataFrame, ids: DataFrame, t: str = "t_ms") -> DataFrame:
    """``tb_id, i, t_ms``: every distinct time vector once, taken from its first channel. Equal ends and lengths do not make vectors equal."""
    owner = ids.groupBy("tb_id").agg(F.min(F.struct("shot", "channel")).alias("o")).select("tb_id", "o.shot", "o.channel")
    return samples.join(owner, ["shot", "channel"]).select("tb_id", "i", t)


def covered(samples: DataFrame, keys: Sequence[str] = ("shot", "channel")) -> DataFrame:
    """``blk, lo, hi``: the stretches of consecutive indices that a channel holds, cut at block borders."""
    d = samples.select(*keys, "i", F.floor(F.col("i") / blocks.BLOCK).alias("blk")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys, "blk").orderBy("i"))
    return d.withColumn("_run", F.col("i") - nth).groupBy(*keys, "blk", "_run").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).drop("_run")


def incremental(requested: DataFrame, attempted: DataFrame, keys: Sequence[str] = ("shot", "channel")) -> DataFrame:
    """Requested names that were not attempted with the same window and decimation."""
    cond = None
    for k in keys:
        c = requested[k] == attempted[k]
        cond = c if cond is None else cond & c
    for k in REDUCTION:
        cond = cond & requested[k].eqNullSafe(attempted[k])
    return requested.join(attempted, cond, "left_anti")


def merge_status(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("shot", "channel")) -> DataFrame:
    """Union of attempts; a name fetched in either one is no longer missing."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.min("status").alias("status"))  # "fetched" sorts before "missing"


class Lake:
    """Parquet tables ``samples``, ``time_bases``, ``covered``, ``channels`` and ``shots`` under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}")

    def exists(self) -> bool:
        """Whether any batch is visible; asked of the file system that holds the lake."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/channels")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def ingest(self, batch: int, samples: DataFrame, shots: DataFrame, *, requested: DataFrame | None = None) -> None:
        """Write one batch: float samples sorted inside each recording, statuses, recording rows.

        Samples of unusable channels are dropped and reported. A batch without a single usable
        channel fails before anything becomes visible.
        """
        status = channel_status(samples)
        if requested is not None:
            absent = requested.select("shot", "channel").join(status, ["shot", "channel"], "left_anti")
            status = status.unionByName(absent.select("shot", "channel", F.lit(0).cast("long").alias("n"), F.lit("missing").alias("status"), F.lit("no data").alias("error"),
                                                           F.lit(None).cast("long").alias("first_i"), F.lit(None).cast("long").alias("last_i")))
        part = f"batch={int(batch)}"
        status.write.mode("overwrite").parquet(f"{self.root}/_staging/channels/{part}")
        staged = self.spark.read.parquet(f"{self.root}/_staging/channels/{part}")
        if not staged.where(F.col("status") == "fetched").limit(1).collect():
            raise ValueError(f"no usable channel in batch {batch}")
        usable = staged.where(F.col("status") == "fetched").select("shot", "channel")
        good = samples.join(usable, ["shot", "channel"], "left_semi")
        ids = time_base_hash(good).join(usable, ["shot", "channel"], "left_semi")
        ids.write.mode("overwrite").parquet(f"{self.root}/_staging/time_ids/{part}")
        ids = self.spark.read.parquet(f"{self.root}/_staging/time_ids/{part}")
        time_bases(good, ids).repartitionByRange("tb_id", "i").sortWithinPartitions("tb_id", "i").write.mode("overwrite").option(
            "compression", "zstd").parquet(f"{self.root}/time_bases/{part}")
        covered(good).write.mode("overwrite").parquet(f"{self.root}/covered/{part}")
        # neighbouring recordings share tasks, so a batch has about as many files as tasks plus recordings
        spread = good.repartitionByRange("shot", "channel", F.floor(F.col("i") / (blocks.BLOCK * 64))).sortWithinPartitions("shot", "channel", "i")
        spread.select("shot", "channel", "i", F.col("value").cast("float").alias("value")).write.mode("overwrite").option("compression", "zstd") \
            .partitionBy("shot").parquet(f"{self.root}/samples/{part}")
        shots.write.mode("overwrite").parquet(f"{self.root}/shots/{part}")
        staged.join(ids, ["shot", "channel"], "left").write.mode("overwrite").parquet(f"{self.root}/channels/{part}")  # last: makes the batch visible

    def shots(self) -> DataFrame:
        """Live recording rows with the batch their current reduction starts at."""
        done = self._read("channels").select("batch").distinct()
        s = self._read("shots").join(done, "batch", "left_semi")
        w = Window.partitionBy("shot").orderBy("batch")
        red = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in REDUCTION])
        s = s.withColumn("_changed", ~red.eqNullSafe(F.lag(red).over(w)))
        attrs = [c for c in s.columns if c not in ("shot", "batch", "analysis", "_changed")]
        start = s.where("_changed").groupBy("shot").agg(F.max("batch").alias("since_batch"))
        live = s.join(start, "shot").where(F.col("batch") >= F.col("since_batch"))
        return live.groupBy("shot").agg(
            F.max("since_batch").alias("since_batch"), F.max_by(F.struct(*attrs), "batch").alias("_a"),
            F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("batch", "analysis"))), lambda x: x["analysis"])), "+").alias("analysis"),
        ).select("shot", "since_batch", "analysis", "_a.*")

    def _fetched(self) -> DataFrame:
        c = self._read("channels").join(self.shots().select("shot", "since_batch"), "shot").where(F.col("batch") >= F.col("since_batch"))
        return c.where(F.col("status") == "fetched").drop("since_batch")

    def parts(self) -> DataFrame:
        """Live fetched batches of every channel: all whose samples no newer one holds too, in whatever order they came."""
        c = self._fetched()
        spans = self._read("covered").join(c.select("shot", "channel", "batch"), ["shot", "channel", "batch"], "left_semi")
        newer = spans.select("shot", "channel", "blk", F.col("batch").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        meets = (F.col("_b") > F.col("batch")) & (F.col("_lo") <= F.col("hi")) & (F.col("lo") <= F.col("_hi"))
        past = spans.join(newer, ["shot", "channel", "blk"]).where(meets).select("shot", "channel", "batch")
        return c.join(past, ["shot", "channel", "batch"], "left_anti")

    def held(self) -> DataFrame:
        """``shot, channel, batch, blk, lo, hi``: the intervals of indices of all live batches."""
        return self._read("covered").join(self.parts().select("shot", "channel", "batch"), ["shot", "channel", "batch"], "left_semi")

    def channels(self) -> DataFrame:
        """Live channel rows: the newest fetched batch of each channel, else its newest attempt; ``n`` counts all live samples."""
        c = self._read("channels").join(self.shots().select("shot", "since_batch"), "shot").where(F.col("batch") >= F.col("since_batch"))
        best = F.struct((F.col("status") == "fetched").cast("int"), "batch")
        newest = c.groupBy("shot", "channel").agg(F.max_by(F.struct("batch", "status", "error", "n"), best).alias("_c")).select("shot", "channel", "_c.*")
        held = self.parts().groupBy("shot", "channel").agg(F.sum("n").alias("_n"), F.max("last_i").alias("last_i"), F.count("*").alias("n_batches"))
        return newest.join(held, ["shot", "channel"], "left").withColumn("n", F.coalesce("_n", "n")).drop("_n")

    def values(self) -> DataFrame:
        """Samples of live channels without times; ``shot`` and ``batch`` are partition columns and prune."""
        return self._read("samples").join(self.parts().select("shot", "channel", "batch"), ["shot", "channel", "batch"], "left_semi")

    def _timed(self, values: DataFrame) -> DataFrame:
        named = values.join(self.parts().select("shot", "channel", "batch", "tb_id"), ["shot", "channel", "batch"])
        return named.join(self._read("time_bases"), ["batch", "tb_id", "i"]).select("shot", "channel", "i", "t_ms", "value", "batch")

    def samples(self) -> DataFrame:
        """Samples of live channels with their times, joined back from the time bases."""
        return self._timed(self._read("samples"))

    def time_report(self) -> DataFrame:
        """Per batch: channels, distinct time vectors, and the bytes of times stored and saved."""
        named = self._read("channels").where(F.col("status") == "fetched").groupBy("batch").agg(
            F.count("*").alias("channels"), F.sum("n").alias("_n"))
        kept = self._read("time_bases").groupBy("batch").agg(F.countDistinct("tb_id").alias("bases"), F.count("*").alias("_kept"))
        return named.join(kept, "batch").select(
            "batch", "channels", "bases", (8 * F.col("_kept")).alias("time_bytes"), (8 * (F.col("_n") - F.col("_kept"))).alias("saved_bytes"))

    def load_channel(self, shot: int, channel: str) -> DataFrame:
        one = self._read("samples").where((F.col("shot") == shot) & (F.col("channel") == channel))
        return self._timed(one).select("i", "t_ms", "value")

    def load_data(self, shot: int, channel: str) -> DataFrame:
        """Values without the time column; the time bases are not read."""
        return self.values().where((F.col("shot") == shot) & (F.col("channel") == channel)).select("i", "value")

    def channel_names(self, shot: int) -> DataFrame:
        return self.channels().where((F.col("shot") == shot) & (F.col("status") == "fetched")).select("channel")

    def list_shots(self) -> DataFrame:
        counts = self.channels().groupBy("shot").agg(F.count_if(F.col("status") == "fetched").alias("n_channels"))
        return self.shots().join(counts, "shot")

    def pending(self, requested: DataFrame) -> DataFrame:
        """What an incremental ingest still has to fetch."""
        s = self.shots().select("shot", *REDUCTION)
        return incremental(requested, self.channels().select("shot", "channel").join(s, "shot"))


# ---- discovery and metadata ---------------------------------------------------------------------
def best_files(files: DataFrame) -> DataFrame:
    """For each recording the file with the most channels; recording 0 and unreadable files drop out."""
    d = files.where(F.col("readable") & (F.col("shot") != 0))
    return d.groupBy("shot").agg(F.max_by(F.struct("path", "n_channels"), F.struct("n_channels", "path")).alias("_f")).select("shot", "_f.*")


def shot_window(shots: DataFrame, samples: DataFrame, t: str = "t_ms") -> DataFrame:
    """Stored window where it is a proper one, else the span of the first channel's time axis."""
    first = samples.groupBy("shot", "channel").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    span = first.groupBy("shot").agg(F.min_by("a", "channel").alias("a"), F.min_by("b", "channel").alias("b"))
    ok = F.col("tmax") > F.col("tmin")
    pick: dict[str, Column] = {"t_lo": F.when(ok, F.col("tmin")).otherwise(F.coalesce("a", F.lit(0.0))),
                               "t_hi": F.when(ok, F.col("tmax")).otherwise(F.coalesce("b", F.lit(0.0)))}
    return shots.join(span, "shot", "left").withColumns(pick).drop("a", "b")


def export(result: DataFrame, path: str, *, kind: str, node_id: str, params: dict[str, str] | None = None, fmt: str = "parquet") -> None:
    """Self-describing result: the rows plus kind, product, parameters and time of writing."""
    params_map = F.create_map(*[F.lit(x) for kv in sorted((params or {}).items()) for x in kv]) if params else F.create_map().cast("map<string,string>")
    d = result.withColumns({"kind": F.lit(kind), "node_id": F.lit(node_id), "params_json": F.to_json(params_map), "generated": F.current_timestamp()})
    doubles = [f.name for f in result.schema.fields if f.dataType.simpleString() == "double"]
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(float("nan"))) for c in doubles})
    d.write.mode("overwrite").format(fmt).save(path)
