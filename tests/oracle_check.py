"""Run registered queries beside their SQL: python tests/oracle_check.py [-d folder] [names...]"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 2**53 else v) if math.isfinite(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def duck(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def compare(spark, con, root: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, root)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return True, f"{len(got[1])} rows, spark {t1 - t0:.1f}s (rows only)"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"{len(got[1])}/{len(want[1])} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"{note}; columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        return False, f"{note}\n   spark only ({len(a - b)}): {sorted(a - b)[:2]}\n   sql only ({len(b - a)}): {sorted(b - a)[:2]}"
    return True, note


if __name__ == "__main__":
    import __spark_entry__ as entry
    from ragframe.session import local_session

    p = argparse.ArgumentParser()
    p.add_argument("-d", default="/root/testdata/sf0.01")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    spark, con = local_session(8), duck(args.d)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args.names and name not in args.names:
            continue
        try:
            ok, note = compare(spark, con, args.d, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        if not ok:
            bad.append(name)
        print("PASS" if ok else "FAIL", name, note, flush=True)
    print(f"{len(bad)} failing: {' '.join(bad)}")
