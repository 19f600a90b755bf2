"""Compare registered queries with their DuckDB counterparts: columns, row counts, values in any order."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def check(spark, con, folder: str, name: str, build, sql: str | None) -> str:
    df = build(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows {len(rows)}"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns), f"{name}: columns {sorted(df.columns)} != {sorted(columns)}"
    assert len(rows) == len(expected), f"{name}: {len(rows)} rows, expected {len(expected)}"
    mine, theirs = normal(df.columns, rows), normal(columns, expected)
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
        raise AssertionError(f"{name}: values differ, e.g. {bad}")
    return f"match {len(rows)}"


if __name__ == "__main__":
    from terraspan.plans.queries import ORACLES, QUERIES
    from terraspan.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    session = build_session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in only or QUERIES:
        t = time.time()
        try:
            note = check(session, con, folder, name, QUERIES[name], ORACLES.get(name))
        except Exception as exc:  # report and go on
            note = "FAILED " + str(exc)[:700]
            failed.append(name)
        print(f"{name:32s} {time.time() - t:6.2f}s {note}", flush=True)
    print(f"{len(only or QUERIES) - len(failed)} ok, {len(failed)} failed: {failed}")
