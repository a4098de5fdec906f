"""Runs catalogue queries beside their SQL in an in-process DuckDB and compares the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value))
    return (type(value).__name__, value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((t, str(v)) for t, v in r))


def difference(spark, connection, name, function, sql, sf_dir):
    """None when equal, else a short description."""
    frame = function(spark, sf_dir)
    got = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    want = _rows(names, found.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"first difference:\n  spark {str(mine)[:600]}\n  sql   {str(theirs)[:600]}"
    return None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from arborlake.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracle = oracle_sql()
    failed = 0
    for name, function in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = difference(spark, connection, name, function, oracle[name], sf_dir)
            else:
                problem = None if function(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
