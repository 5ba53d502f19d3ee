"""Query and oracle registries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` only its rows are checked."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def out(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round double columns so that both engines agree to the last printed digit."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            cols.append((F.round(F.col(f.name).cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
