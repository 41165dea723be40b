"""Run the registered queries next to their SQL and compare whole results.

    python -m loglantern.checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from typing import Any

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value: Any) -> Any:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, query, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _rows(names, cur.fetchall())
    t2 = time.time()
    note = f"{len(mine)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if mine == theirs:
        return True, note
    left, right = set(mine) - set(theirs), set(theirs) - set(mine)
    return False, (
        f"{note}; {len(mine)} vs {len(theirs)} rows; columns {sorted(names)}; "
        f"spark only {sorted(left)[:2]}; sql only {sorted(right)[:2]}"
    )


def main(argv: list[str]) -> int:
    from loglantern.checks.queries import QUERIES
    from loglantern.checks.reference_sql import SQL
    from loglantern.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark, con = local_session(), duck(sf_dir)
    failed = 0
    for name in wanted:
        if name not in SQL:
            t0 = time.time()
            print(f"rows  {name}: {QUERIES[name](spark, sf_dir).count()} rows, {time.time() - t0:.1f}s", flush=True)
            continue
        ok, note = compare(spark, con, sf_dir, QUERIES[name], SQL[name])
        failed += not ok
        print(f"{'ok   ' if ok else 'FAIL '} {name}: {note}", flush=True)
    print(f"{failed} failed of {len(wanted)}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
