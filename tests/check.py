"""Compare registered queries with their SQL on the given tables.

Usage: python tests/check.py [name-prefix ...]   (all queries without arguments)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), sorted(cols)


def compare(df, con, sql):
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wc = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gc != wc:
        return f"columns {gc} != {wc}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ in {gc}: spark {bad[0][0]} sql {bad[0][1]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from barloom.session import session

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = session("check"), oracle(sf)
    qs, orc = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:]
    fails = []
    for name, fn in qs.items():
        if want and not any(name.startswith(p) for p in want):
            continue
        t0 = time.time()
        try:
            if name in orc:
                err, n = compare(fn(spark, sf), con, orc[name])
            else:
                n, err = fn(spark, sf).count(), None
        except Exception as e:  # report and go on with the next query
            err, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        flag = "FAIL" if err else ("ok  " if name in orc else "rows")
        print(f"{flag} {name:32s} {n:7d} rows {time.time() - t0:6.2f}s {err or ''}", flush=True)
        if err:
            fails.append(name)
    print("failed:", fails)
