"""Compare registered queries with their SQL on one data folder."""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from tracefold.plans.catalog import load
from tracefold.plans.views import BASE
from tracefold.session import local_session


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--data", default="/root/testdata/sf0.01")
    parser.add_argument("--prefix", default="")
    args = parser.parse_args()
    spark = local_session(8)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.data}/{table}.parquet'")
    bad = 0
    for name, q in load().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = q.run(spark, args.data)
            got = rows_of(df.columns, df.collect())
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: spark {str(exc)[:600]}", flush=True)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(got)} ({took:.1f}s)", flush=True)
            continue
        start = time.time()
        try:
            rel = con.sql(q.oracle())
            columns, types = list(rel.columns), [str(x) for x in rel.types]
            want = rows_of(columns, rel.fetchall())
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: sql {str(exc)[:600]}", flush=True)
            continue
        notes = [t for t in types if t.startswith(("HUGEINT", "DECIMAL"))]
        if sorted(columns) != sorted(df.columns):
            notes.append(f"columns {sorted(df.columns)} / {sorted(columns)}")
        same = got == want
        state = "ok  " if same and not notes else "DIFF"
        bad += state == "DIFF"
        print(f"{state} {name}: {len(got)} / {len(want)} rows ({took:.1f}s, sql "
              f"{time.time() - start:.1f}s) {notes or ''}", flush=True)
        if not same:
            left, right = set(got), set(want)
            only, other = sorted(left - right, key=repr)[:3], sorted(right - left, key=repr)[:3]
            print("   spark:", repr(only)[:700], "\n   sql:  ", repr(other)[:700])
    print("bad:", bad)


if __name__ == "__main__":
    main()
