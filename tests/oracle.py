"""Runs a query on Spark and its SQL twin on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "null")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("n", round(float(v), 6))
    return ("s", str(v))


def compare(spark, con, name, query, sql, sf) -> str | None:
    """None when the results agree, else what differs."""
    df = query(spark, sf)
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    left = sorted(tuple(_plain(r[c]) for c in cols) for r in got)
    at = [names.index(c) for c in cols]
    right = sorted(tuple(_plain(r[i]) for i in at) for r in want)
    if left == right:
        return None
    extra = sorted(set(left) - set(right))[:2]
    missing = sorted(set(right) - set(left))[:2]
    return f"rows {len(left)} vs {len(right)}; cols {cols}; only spark {extra}; only sql {missing}"


if __name__ == "__main__":
    from caseloom.plans import registry
    from caseloom.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, query in registry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            sql = registry.oracle_sql().get(name)
            if sql:
                problem = compare(spark, con, name, query, sql, sf)
            else:
                problem, n = None, query(spark, sf).count()
                print("rows only", n, end=" ")
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    os._exit(0)
