"""Run registered queries beside their DuckDB twins and compare every value.

    python tests/compare.py [-s 0.001] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, v)
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, v)
    return (1, v)


def diff(spark_df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    cols = sorted(spark_df.columns)
    got = [tuple(r[c] for c in cols) for r in spark_df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in res.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}\n  spark {got[:3]}\n  duck  {want[:3]}"
    key = lambda r: repr([norm(v) for v in r])
    got.sort(key=key)
    want.sort(key=key)
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if type(a) is not type(b) or norm(a) != norm(b):
                bad = sum(1 for x, y in zip(got, want) if x != y)
                return f"{bad} rows differ; first at {c}: {a!r} vs {b!r}\n  spark {g}\n  duck  {w}"
    return None


def main() -> None:
    from tidemark.registry import load_all
    from tidemark.session import build_session

    args = sys.argv[1:]
    sf = "0.01"
    if args and args[0] == "-s":
        sf, args = args[1], args[2:]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(f"{DATA}/sf{sf}")
    bad = 0
    for name, q in load_all().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = q.run(spark, f"{DATA}/sf{sf}")
            if q.sql is None:
                n = len(df.collect())
                msg = None if n else "no rows"
                note = f"rows-only {n}"
            else:
                msg, note = diff(df, con, q.sql), "same"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t:.1f}s {msg or note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
