"""Side-by-side comparison of a registered query and its SQL."""
from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, (int, float)):
        f = float(v)
        return (2, "nan") if math.isnan(f) else (2, repr(f + 0.0))
    return (3, str(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return [columns[j] for j in order], sorted(tuple(_norm(rec[j]) for j in order) for rec in records)


def compare(spark, con, sf, fn, sql) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    a_cols, a = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    odd = [c[0] for c in cur.description if any(x in str(c[1]).upper() for x in ("DECIMAL", "HUGEINT", "NUMBER("))]
    b_cols, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if odd:
        return f"exact numeric types in {odd}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {dict(zip(a_cols, [v[1] for v in bad[0][0]]))} != {[v[1] for v in bad[0][1]]}"
    return None


if __name__ == "__main__":
    import workload
    from ringwave.session import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(workload.QUERIES)
    spark = local_session()
    con = connect(sf)
    for name in names:
        t = time.time()
        try:
            if name in workload.ORACLE:
                res = compare(spark, con, sf, workload.QUERIES[name], workload.ORACLE[name]) or "ok"
            else:
                res = f"rows {workload.QUERIES[name](spark, sf).count()}"
        except Exception as e:
            lines = str(e).strip().splitlines()
            res = "ERROR " + type(e).__name__ + " " + " | ".join(lines[:3])[:400]
        print(f"{name:32s} {time.time() - t:6.1f}s {res}", flush=True)
