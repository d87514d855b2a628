"""Run queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/oracle.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def compare(spark, con, fn, sql: str, sf: str) -> tuple[bool, str]:
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = _sorted([tuple(_cell(r[c]) for c in cols) for r in df.collect()])
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return False, f"columns {cols} vs {sorted(rel.columns)}"
    at = [rel.columns.index(c) for c in cols]
    want = _sorted([tuple(_cell(r[i]) for i in at) for r in rel.fetchall()])
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; {got[:2]} vs {want[:2]}"
    for a, b in zip(got, want):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return False, f"{cols}: {a} vs {b}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from framemetry.plans import ORACLES, QUERIES
    from framemetry.session import local_session

    sf = f"{DATA}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)] if sys.argv[2:] else names
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8"})
    con = connect(sf)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
            else:
                ok, note = True, f"{QUERIES[name](spark, sf).count()} rows, no SQL"
        except Exception as exc:  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.2f}s {note}", flush=True)
    print(f"{bad} failures of {len(names)}")
