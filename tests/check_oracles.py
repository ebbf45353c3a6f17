"""Run registered queries beside their SQL: ``python tests/check_oracles.py [folder] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, bool) or v is None:
            return str(v)
        return repr(float(v)) if isinstance(v, int) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def views(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    """None when both agree (or there is no SQL), else what differs."""
    df = fn(spark, folder)
    got, columns = canonical(df.columns, [tuple(r) for r in df.collect()])
    if not got:
        return "no rows"
    if sql is None:
        return None
    cur = con.execute(sql)
    want, want_columns = canonical([d[0] for d in cur.description], cur.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if got != want:
        extra, lost = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows vs {len(want)}; only here {extra}; only there {lost}"
    return None


if __name__ == "__main__":
    from tests.session import make_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = make_session(), views(folder)
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            error = compare(spark, con, folder, name, fn, entry.oracle_sql().get(name))
        except Exception as e:
            error = f"{type(e).__name__}: {str(e)[:600]}"
        bad += error is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {error or 'ok'}", flush=True)
    print(f"{bad} differ")
