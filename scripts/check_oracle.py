"""Run queries in Spark and their oracle SQL in DuckDB; compare row counts,
column names and values (order-insensitive).

usage: python scripts/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from ragtide.plans.catalog import QUERIES  # noqa: E402
from ragtide.plans.oracle import SQL  # noqa: E402
from ragtide.session import local_session  # noqa: E402
from ragtide.sources.tables import TABLES  # noqa: E402


def norm_value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(norm_value(r[c]) for c in cols) for _, r in pdf.iterrows())
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = 0
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            continue
        ts = time.time() - t0
        if name not in SQL:
            print(f"{name:28s} rows={len(sdf)} (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.execute(SQL[name]).fetchdf()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {type(e).__name__}: {str(e)[:300]}")
            continue
        a, b = digest(sdf), digest(odf)
        status = "OK" if a == b else "MISMATCH"
        ok += a == b
        print(f"{name:28s} {status} spark_rows={a[0]} oracle_rows={b[0]} {ts:.1f}s")
        if a[1] != b[1]:
            print("   columns:", a[1], b[1])
        elif a != b:
            cols = a[1]
            s_rows = sorted(tuple(norm_value(r[c]) for c in cols) for _, r in sdf.iterrows())
            o_rows = sorted(tuple(norm_value(r[c]) for c in cols) for _, r in odf.iterrows())
            diff = [(x, y) for x, y in zip(s_rows, o_rows) if x != y][:3]
            for x, y in diff:
                print("   spark :", [v[:80] for v in x])
                print("   oracle:", [v[:80] for v in y])
            print("   dtypes spark:", dict(sdf.dtypes.astype(str)), "oracle:", dict(odf.dtypes.astype(str)))
    print(f"{ok}/{sum(1 for n in names if n in SQL)} oracle matches")


if __name__ == "__main__":
    main()
