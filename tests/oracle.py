"""Compare registered queries with their SQL forms: ``python tests/oracle.py [sf] [name-prefix…]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("n", "nan") if math.isnan(v) else ("n", repr(v + 0.0))
    if isinstance(v, int):
        return ("n", repr(float(v)))
    return ("z", repr(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    """Return (problem or None, row count, seconds)."""
    start = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if len(set(df.columns)) != len(df.columns):
        return "duplicate column names", len(got), took
    if sql is None:
        return (None if got else "no rows"), len(got), took
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), took
    if not got:
        return "no rows", 0, took
    if got != want:
        a = [r for r in got if r not in set(want)][:2]
        b = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; spark only {a}; sql only {b}", len(got), took
    return None, len(got), took


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark, con, sqls, bad = session(), database(folder), oracle_sql(), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) or fn.__module__.endswith(w) for w in wanted):
            continue
        try:
            problem, n, took = compare(spark, con, fn, sqls.get(name), folder)
        except Exception as e:  # report and go on with the next query
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {'' if name in sqls else '(rows only) '}{n} rows {took:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
