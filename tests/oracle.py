"""Run registered queries and their SQL checks side by side and compare the rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

from asklens.views import TABLES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    """(ok, message) of one query."""
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(got), f"{name}: rows only, {len(got)} rows, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    checked = time.time() - start
    if sorted(df.columns) != sorted(names):
        return False, f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        return False, f"{name}: {len(a)} vs {len(b)} rows\n  ours  {str(only_a)[:900]}\n  check {str(only_b)[:900]}"
    return True, f"{name}: ok, {len(a)} rows, {took:.1f}s, check {checked:.1f}s"


if __name__ == "__main__":
    import sys

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from asklens.plans import CHECKS, QUERIES, load_all
    from asklens.session import build_session

    load_all()
    sf = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message = compare(spark, con, name, fn, CHECKS.get(name), sf)
        except Exception as problem:
            ok, message = False, f"{name}: {type(problem).__name__} {str(problem)[:1500]}"
        bad += not ok
        print(("  " if ok else "BAD ") + message, flush=True)
    print("bad:", bad)
