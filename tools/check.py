"""Run registered queries in Spark and in DuckDB on the same tables and compare the rows.

python tools/check.py [--sf 0.01] [pattern ...]
"""

from __future__ import annotations

import argparse
import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from thermogrid.catalog.registry import all_queries  # noqa: E402
from thermogrid.catalog.views import TABLES  # noqa: E402
from thermogrid.session import local_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(value):
    if value is None:
        return "\0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}" if abs(value) < 1e12 else f"{value:.6e}"
    if isinstance(value, int):
        return f"{value:.6f}"
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    return str(value)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_cols, spark_rows, duck_cols, duck_rows) -> str | None:
    sc, sr = canon(spark_cols, spark_rows)
    dc, dr = canon(duck_cols, duck_rows)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, first {sc}\n      spark {bad[0][0]}\n      duck  {bad[0][1]}"
    return None


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("patterns", nargs="*")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed, times = [], []
    for key, q in all_queries().items():
        if a.patterns and not any(re.search(x, key) for x in a.patterns):
            continue
        t = time.time()
        try:
            df = q.run(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - t
            times.append((took, key))
            if q.sql is None:
                print(f"rows  {key} {len(rows)} ({took:.1f}s)", flush=True)
                continue
            t = time.time()
            cur = con.execute(q.sql)
            cols = [d[0] for d in cur.description]
            problem = compare(df.columns, rows, cols, cur.fetchall())
            td = time.time() - t
            print(f"{'ok   ' if problem is None else 'DIFF '} {key} {len(rows)} ({took:.1f}s / {td:.1f}s)", flush=True)
            if problem:
                failed.append(key)
                print("     ", problem, flush=True)
            elif not rows:
                print("      EMPTY", flush=True)
        except Exception as exc:  # noqa: BLE001
            failed.append(key)
            print(f"FAIL  {key}: {type(exc).__name__} {str(exc)[:700]}", flush=True)
    times.sort(reverse=True)
    print("slowest:", [(round(t, 1), k) for t, k in times[:12]])
    print(f"{len(failed)} failed of {len(times)}: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
