"""Run registered queries next to their oracle SQL: ``python tests/compare.py [sf] [name part]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description of the first difference."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from tersa.workload.queries import ORACLES, QUERIES

    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    part = sys.argv[2] if len(sys.argv) > 2 else ""
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connection(sf)
    for name, query in QUERIES.items():
        if not any(p in name for p in part.split(",")):
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            if name in ORACLES:
                result = difference(df, con, ORACLES[name]) or "ok"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as exc:  # noqa: BLE001
            result = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:34s} {time.time() - start:6.1f}s  {result}", flush=True)
