"""Run registered queries and their SQL twins on the same tables and compare the results as sets of rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labelwright.plans.views import TABLE_NAMES  # noqa: E402


def connect(path: str):
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, path):
    df = query(spark, path)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    if got != want:
        a, b = set(got), set(want)
        only_got, only_want = sorted(a - b)[:3], sorted(b - a)[:3]
        return f"rows {len(got)} vs {len(want)}; spark only {only_got}; sql only {only_want}", len(got)
    return None, len(got)


def main() -> int:
    import importlib
    entry = importlib.import_module("__spark_entry__")
    from labelwright.session import local_session
    scale = "0.01"
    wanted = [a for a in sys.argv[1:] if not a.startswith("--sf=")]
    for a in sys.argv[1:]:
        if a.startswith("--sf="):
            scale = a[5:]
    path = f"/root/testdata/sf{scale}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, name, fn, oracles[name], path)
            else:
                problem, n = None, len(fn(spark, path).collect())
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        mark = "ok  " if problem is None else "FAIL"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {name} [{kind}] rows={n} {time.time() - start:.1f}s" + (f"  {problem}" if problem else ""), flush=True)
        if problem is None and n == 0:
            print(f"     {name}: EMPTY RESULT")
        failed += problem is not None
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
