"""Run registered queries against their SQL in DuckDB: python tests/check.py [-s SF] [name ...]"""

import argparse
import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
from boutline.session import local_session  # noqa: E402
from boutline.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return norm(float(v))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(con, spark, name, fn, sql, folder):
    """None when equal, else what differs."""
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return None, len(got), spent, "rows only"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    note = f"sql {time.time() - start:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got), spent, note
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} rows != {len(want)}; cols {sorted(cols)}; first {diff}", len(got), spent, note
    return None, len(got), spent, note


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("-m", default=None, help="only queries of this module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import importlib

    from boutline.plans import load_all, registry
    if a.m:
        importlib.import_module(f"boutline.plans.{a.m}_queries")
    else:
        load_all()
    folder = f"/root/testdata/sf{a.s}"
    spark, con, bad = local_session(), connect(folder), []
    for name in a.names or registry.QUERIES:
        try:
            err, n, spent, note = compare(con, spark, name, registry.QUERIES[name], registry.ORACLES.get(name), folder)
        except Exception as e:  # report and go on
            err, n, spent, note = f"{type(e).__name__}: {str(e)[:900]}", -1, 0, ""
        print(f"{'ok  ' if err is None else 'FAIL'} {name} rows={n} {spent:.1f}s {note} {err or ''}", flush=True)
        if err:
            bad.append(name)
    print("failed:", bad)
