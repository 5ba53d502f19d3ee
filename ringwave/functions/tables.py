"""Table functions for SQL."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


class Frames:
    """``frames(TABLE(samples) PARTITION BY (shot, channel, part) ORDER BY (i), n_fft, hop)``: one row per whole frame.

    Rows come in order of ``i``; only the last ``n_fft`` values are held. Where an index is missing, frames over it are left
    out; a repeated index counts once, by its first row. Null values make null entries.
    """

    def __init__(self) -> None:
        self.values: list = []
        self.next = None

    def eval(self, row: Row, n_fft: int, hop: int) -> Iterator[tuple]:
        i = row["i"]
        if self.next is not None and i < self.next:
            return
        if self.next != i:
            # a frame begins at a multiple of the hop
            self.values = []
            self.start = -(-i // hop) * hop
        self.next = i + 1
        if i < self.start:
            return
        self.values.append(row["value"])
        if len(self.values) == n_fft:
            yield row["shot"], row["channel"], self.start // hop, list(self.values)
            gone = min(hop, n_fft)
            self.values = self.values[gone:]
            self.start += hop


FRAME = "shot bigint, channel string, frame bigint, samples array<double>"


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("frames", udtf(Frames, returnType=FRAME))


def framing_parts(samples: DataFrame, n_fft: int, hop: int, frames: int = 512) -> DataFrame:
    """Add ``part``: stretches of ``frames`` frames, so that no record has to go through one task.

    Samples that frames of two parts hold are given to both; with ``frames`` many times ``n_fft / hop`` these are few.
    """
    width = frames * hop
    first: Column = F.greatest(F.lit(0), F.floor((F.col("i") - (n_fft - hop)) / width))
    return samples.withColumn("part", F.explode(F.sequence(first, F.floor(F.col("i") / width))))
