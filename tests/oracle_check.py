"""Run registered queries in Spark and their SQL in DuckDB; compare like the driver does.

usage: python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or v is getattr(__import__("pandas"), "NA", None):
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer():
            return str(int(v))
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def frame_hash(df) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def main(argv):
    import duckdb
    import __spark_entry__ as entry
    from slicewise.session import get_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries = entry.queries()
    oracle = entry.oracle_sql()
    ok = 0
    for name in names or list(queries):
        t0 = time.time()
        try:
            sdf = queries[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"{name:32s} rows={len(sdf)} (no oracle) spark={ts:.1f}s")
            continue
        t1 = time.time()
        try:
            odf = con.execute(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCKDB ERROR {str(e)[:300]}")
            continue
        to = time.time() - t1
        a, b = frame_hash(sdf), frame_hash(odf)
        same = a == b
        ok += same
        print(f"{name:32s} {'OK ' if same else 'BAD'} rows={a[0]}/{b[0]} cols_equal={a[1] == b[1]} "
              f"spark={ts:.1f}s duck={to:.1f}s")
        if not same and a[1] != b[1]:
            print("   spark cols", a[1], "\n   duck  cols", b[1])
        elif not same:
            cols = a[1]
            rs = set("|".join(_norm(r[c]) for c in cols) for r in sdf[cols].to_dict("records"))
            ro = set("|".join(_norm(r[c]) for c in cols) for r in odf[cols].to_dict("records"))
            print("   cols:", cols)
            for x in sorted(rs - ro)[:3]:
                print("   spark only:", x[:400])
            for x in sorted(ro - rs)[:3]:
                print("   duck  only:", x[:400])
    print(f"{ok} matched")


if __name__ == "__main__":
    main(sys.argv)
