"""Session helpers for tests, the bench and local runs; a cluster brings its own session."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "ringwave") -> SparkSession:
    """A small local session. Only tests and ``bench.py`` use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a new local folder only when unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, *by: str, codec: str = "snappy") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where several steps read the same expensive result. The table is columnar, so later reads
    prune columns, its size is known to the planner, and a lost executor re-reads files instead of
    recomputing the lineage. With ``by`` there is a folder for each value of these columns.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ringwave-{uuid.uuid4().hex}"
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
