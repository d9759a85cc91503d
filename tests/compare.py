"""Run registered queries against DuckDB on the same Parquet tables.

    python -m tests.compare [sf dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).rsplit(".", 1)[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


# SQL type names of the two engines.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
# Plan nodes no registered query may have.
UNWANTED = ("CartesianProduct", "NestedLoopJoin", "Python", "Arrow")


def difference(spark, con, sf_dir: str, name: str, queries, oracles) -> str | None:
    """None if the query and its SQL agree, else what differs."""
    frame = queries[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    unwanted = [node for node in UNWANTED if node in plan]
    if unwanted:
        return f"plan has {unwanted}"
    got_names, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in oracles:
        return None
    result = con.execute(oracles[name])
    names, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_names != names:
        return f"columns {got_names} / {names}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference:\n  spark  {a}\n  duckdb {b}"
    types = {c: TYPES.get(t, t) for c, t in frame.dtypes}
    wanted = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracles[name]}").fetchall()}
    return f"types {types} / {wanted}" if types != wanted else None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tests.sessions import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    table, oracles = queries(), oracle_sql()
    bad = 0
    for name in argv[1:] or table:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name, table, oracles)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(argv[1:] or table)} queries, {bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(main(sys.argv[1:]))
