"""Run registered queries against their SQL counterparts in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark_df, con, sql):
    a_names, a = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    b_names, b = rows_of([x[0] for x in cur.description], cur.fetchall())
    if a_names != b_names:
        return f"columns differ: {a_names} / {b_names}"
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only spark {list(sa - sb)[:2]}; only sql {list(sb - sa)[:2]}"
    for x, y in zip(a, b):
        if x != y:
            diff = [(n, p, q) for n, p, q in zip(a_names, x, y) if p != q]
            sa, sb = set(a), set(b)
            return f"{len(sa - sb)} of {len(a)} rows differ, first {diff} in {x}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as E
    from tallyfold.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    pattern = sys.argv[2:] or [""]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if not any(name.startswith(p) for p in pattern):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                err = compare(df, con, oracles[name])
            else:
                err = None if df.count() >= 0 else "?"
                name += " (no sql)"
        except Exception as e:  # report and go on
            err = f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        n = "" if err else "ok"
        print(f"{name:40s} {time.time() - t0:6.1f}s {n or err}", flush=True)
    print("failed:", bad)
