"""Compare registered queries with their SQL counterpart in DuckDB.

Usage: python -m tests.compare [folder] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


def kind(v):
    return "int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    pick = [names.index(c) for c in cols]
    right_rows = [tuple(norm(r[i]) for i in pick) for r in cur.fetchall()]
    left_rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if len(left_rows) != len(right_rows):
        return f"rows {len(left_rows)} != {len(right_rows)}"
    left, right = Counter(left_rows), Counter(right_rows)
    if left != right:
        a, b = list((left - right).elements()), list((right - left).elements())
        return f"{len(a)} rows differ of {len(left_rows)}; cols {cols}\n   spark {sorted(a, key=str)[:3]}\n   duck  {sorted(b, key=str)[:3]}"
    if left_rows:
        for i, c in enumerate(cols):
            lk = {kind(r[i]) for r in left_rows if r[i] is not None}
            rk = {kind(r[i]) for r in right_rows if r[i] is not None}
            if lk != rk:
                return f"type of {c}: {lk} != {rk}"
    return None


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from tabloom.session import local_session

    spark = local_session(8)
    con = duck(folder)
    queries, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                msg = compare(df, con, sqls[name])
                note = "ok" if msg is None else "DIFF " + msg
            else:
                rows = df.collect()
                note = f"rows-only {len(rows)} e.g. {str(rows[0])[:200] if rows else ''}"
                msg = None if rows else "empty"
        except Exception as ex:  # noqa: BLE001
            msg = note = "ERROR " + str(ex)[:1200]
        bad += msg is not None
        print(f"{time.time() - t0:6.1f}s {name}: {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
