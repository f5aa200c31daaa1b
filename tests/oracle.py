"""Runs registered queries against their SQL twins in DuckDB.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, (float, decimal.Decimal)):
        return "float"
    return type(v).__name__


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], [tuple(plain(r[i]) for i in order) for r in rows]


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (ok, message)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    cols, got = rows_of(df.columns, got)
    if sql is None:
        return True, f"rows-only {len(got)} rows, spark {t1 - t0:.2f}s"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_cols, want = rows_of(want_cols, cur.fetchall())
    t2 = time.time()
    if cols != want_cols:
        return False, f"columns {cols} vs {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}"
    key = lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) else (False, "n", x) for x in r)
    got.sort(key=key)
    want.sort(key=key)
    for i, c in enumerate(cols):
        ks = {kind(r[i]) for r in got if r[i] is not None}, {kind(r[i]) for r in want if r[i] is not None}
        if ks[0] != ks[1]:
            return False, f"column {c}: types {ks[0]} vs {ks[1]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got)} rows differ, first:\n   {cols}\n   {bad[0][0]}\n   {bad[0][1]}"
    return True, f"{len(got)} rows, spark {t1 - t0:.2f}s, duckdb {t2 - t1:.2f}s"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    import __spark_entry__ as e
    from rankloom.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    names = argv or list(qs)
    failed = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, qs[n], os_.get(n), sf_dir)
        except Exception as ex:  # report and go on to the next query
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:1500]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + n + ": " + msg, flush=True)
    print(f"{len(names) - failed}/{len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
