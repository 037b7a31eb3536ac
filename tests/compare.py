"""Spark result against its DuckDB check: columns, rows and values."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.10g}"
    if hasattr(v, "isoformat"):
        return "~" if str(v) == "NaT" else v.isoformat()[:26]
    if isinstance(v, (int,)):
        return f"{float(v):.10g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} vs {len(want)}")
    if got != want and not problems:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        problems.append(f"{len(bad)} differing, first {bad[0]}")
    elif got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        problems.append(f"extra {extra} missing {missing}")
    return len(got), problems


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from cutline import workload
    from cutline.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session("compare")
    con = connect(sf_dir)
    sqls = workload.checks()
    for name, fn in workload.queries().items():
        if only and name not in only and not any(fn.__module__.endswith(o) for o in only):
            continue
        start = time.time()
        try:
            if name in sqls:
                n, problems = compare(spark, con, fn, sqls[name], sf_dir)
            else:
                n, problems = fn(spark, sf_dir).count(), ["(no check)"]
        except Exception as exc:
            n, problems = -1, [f"{type(exc).__name__}: {str(exc)[:700]}"]
        state = "ok  " if not problems else "----"
        print(f"{state} {name:28s} rows={n} {time.time() - start:.1f}s {' '.join(map(str, problems))[:900]}", flush=True)
