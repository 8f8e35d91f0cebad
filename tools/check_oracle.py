"""Run registered queries next to their SQL on DuckDB and compare rows.

    python tools/check_oracle.py [--sf 0.01] [name-substring ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def compare(query, spark, con, sf_dir: str) -> str:
    df = query.run(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(c in plan for c in CROSS):
        return "MISMATCH cross product in the plan"
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if query.sql is None:
        return f"rows-only {len(got)}"
    rel = con.execute(query.sql)
    columns = [d[0] for d in rel.description]
    want = normal(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"MISMATCH columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return f"MISMATCH rows {len(got)} vs {len(want)}; first {diff[:2]}"
    kinds = {tuple(type(v).__name__ for v in r) for r in got[:50]}, {tuple(type(v).__name__ for v in r) for r in want[:50]}
    if kinds[0] != kinds[1]:
        return f"MISMATCH types {kinds}"
    return f"ok {len(got)}"


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    from evidra.catalog import load_all
    from evidra.session import build_session

    sf_dir = f"/root/testdata/sf{opts.sf}"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load_all().items():
        if opts.names and not any(n in name for n in opts.names):
            continue
        start = time.time()
        try:
            result = compare(q, spark, con, sf_dir)
        except Exception as e:  # report every query, then fail at the end
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = result.startswith(("MISMATCH", "ERROR"))
        bad += flag
        print(f"{name:40s} {time.time() - start:6.1f}s {result[:1500]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
