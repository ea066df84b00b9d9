"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from wordloom.plans.common import TABLES  # noqa: E402
from wordloom.plans.registry import oracle_sql, queries  # noqa: E402
from wordloom.session import build_session  # noqa: E402


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, sf_dir, name, q, sql, con):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(srows), oracle=None, spark_s=round(t1 - t0, 2))
    odf = con.execute(sql).fetchdf()
    cols = sorted(odf.columns)
    orows = [tuple(_norm(None if (isinstance(x, float) and math.isnan(x)) else x) for x in row)
             for row in odf[cols].itertuples(index=False, name=None)]
    t2 = time.time()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    ok_cols = sorted(sdf.columns) == cols
    ok = ok_cols and sorted(srows, key=key) == sorted(orows, key=key)
    res = dict(name=name, rows=len(srows), orows=len(orows), cols_ok=ok_cols, match=ok,
               spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if not ok:
        ss, os_ = set(map(key, srows)), set(map(key, orows))
        res["spark_only"] = [r for r in srows if key(r) not in os_][:3]
        res["oracle_only"] = [r for r in orows if key(r) not in ss][:3]
        if not ok_cols:
            res["cols"] = (sorted(sdf.columns), cols)
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sq = queries(), oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, sf_dir, name, qs[name], sq.get(name), con)
        except Exception as e:  # report and go on
            r = dict(name=name, error=repr(e)[:800])
        if r.get("match") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
