"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results.

    python tests/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        f = float(v)
        return (0, "") if math.isnan(f) else (2, f)
    if type(v).__name__ == "Decimal":
        return (2, float(v))
    return (1, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    got_c, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_c, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_c != want_c:
        return f"columns {got_c} != {want_c}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        loose = sum(
            1 for a, b in bad
            if not all(x == y or (x[0] == y[0] == 2 and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))
        )
        def show(r):
            return [x[1] for x in r]
        return f"{len(bad)} rows differ ({loose} beyond 1e-9); e.g. {got_c}\n   spark {show(bad[0][0])}\n   duck  {show(bad[0][1])}", len(got)
    return None, len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = f"/root/testdata/sf{a.sf}"
    spark, con = local_session("8"), duck(sf_dir)
    qs, sq = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not a.names or any(n.startswith(p) for p in a.names)]
    fails = 0
    for n in names:
        t = time.time()
        try:
            if n in sq:
                err, count = compare(qs[n](spark, sf_dir), con, sq[n])
            else:
                err, count = None, len(qs[n](spark, sf_dir).collect())
        except Exception as e:  # noqa: BLE001
            err, count = f"{type(e).__name__}: {str(e)[:700]}", -1
        fails += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {n:44s} rows={count:7d} {time.time() - t:6.2f}s {'' if n in sq else '(rows only)'} {err or ''}", flush=True)
    print(f"{len(names) - fails}/{len(names)} ok")


if __name__ == "__main__":
    main()
