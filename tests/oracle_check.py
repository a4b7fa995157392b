"""Compare registered Spark queries with their DuckDB oracles.

Mirrors the acceptance check: same column names, same row count, and the same
multiset of rows (order-insensitive), columns taken in sorted-name order.
Usable from pytest and as a script: ``python tests/oracle_check.py [names...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int,)):
        return v
    return str(v)


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name: str, build, sql: str | None, sf_dir: str, con=None) -> dict:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    scols = sdf.columns
    srecs = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srecs), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["ok"] = True
        res["kind"] = "rows-only"
        return res
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drecs = cur.fetchall()
    res["duck_rows"] = len(drecs)
    res["cols_ok"] = sorted(scols) == sorted(dcols)
    if not res["cols_ok"]:
        res["ok"] = False
        res["detail"] = f"spark cols {sorted(scols)} vs duck {sorted(dcols)}"
        return res
    a, b = _rows(scols, srecs), _rows(dcols, drecs)
    res["ok"] = a == b
    if not res["ok"]:
        sa, sb = set(a), set(b)
        only_s = [x for x in a if x not in sb][:2]
        only_d = [x for x in b if x not in sa][:2]
        res["detail"] = f"only spark: {str(only_s)[:600]} | only duck: {str(only_d)[:600]}"
    return res


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from sparkprep.session import local_session
    from sparkprep.plans.registry import all_queries
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8, 8)
    qs = all_queries()
    names = [n for n in qs if not argv or any(n.startswith(a) for a in argv)]
    con = duck(sf_dir)
    bad = 0
    for n in names:
        q = qs[n]
        try:
            r = compare(spark, n, q.build, q.sql, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"name": n, "ok": False, "detail": f"{type(e).__name__}: {str(e)[:500]}"}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), n, {k: v for k, v in r.items() if k not in ("name", "ok")},
              flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
