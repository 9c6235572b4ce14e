"""Compare registered queries with their SQL: `python tests/parity.py [names...]` (sf0.01 unless SF_DIR is set)."""

from __future__ import annotations

import datetime
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None when equal, else what differs."""
    cur = con.execute(sql)
    ccols, crows = table([d[0] for d in cur.description], cur.fetchall())
    scols, srows = table(df.columns, [tuple(r) for r in df.collect()])
    if scols != ccols:
        return f"columns {scols} vs {ccols}"
    if len(srows) != len(crows):
        return f"rows {len(srows)} vs {len(crows)}; spark {srows[:3]} duck {crows[:3]}"
    diff = [(a, b) for a, b in zip(srows, crows) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(diff)}/{len(srows)} differ, first {diff[0]}" if diff else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    from portlake.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls, con = entry.queries(), entry.oracle_sql(), connect(folder)
    names = sys.argv[1:] or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            msg = compare(df, con, sqls[n]) if n in sqls else f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            msg = "ERROR " + str(e).replace("\n", " ")[:500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = msg is None or msg.startswith("(rows")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print("failed:", bad, "of", len(names))
