"""Compare queries with their SQL on the same tables.

Run ``python -m tests.oracle [folder] [query ...]`` for a report over all or some queries.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return value


def sorted_rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(body, key=repr)


def differences(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """(rows, what differs)."""
    names, rows = sorted_rows(result.columns, result.collect())
    answer = connection.execute(sql)
    columns = [d[0] for d in answer.description]
    expected_names, expected = sorted_rows(columns, answer.fetchall())
    problems = []
    if names != expected_names:
        problems.append(f"columns {names} != {expected_names}")
    if len(rows) != len(expected):
        problems.append(f"{len(rows)} rows != {len(expected)}")
    for mine, theirs in zip(rows, expected):
        types = [(type(a).__name__, type(b).__name__) for a, b in zip(mine, theirs) if a is not None and b is not None]
        if mine != theirs or any(a != b for a, b in types):
            problems.append(f"{mine!r:.300} != {theirs!r:.300}")
            break
    return len(rows), problems


def main(argv: list[str]) -> int:
    from grapevine.queries import QUERIES, SQL
    from grapevine.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:] or list(QUERIES)
    spark = local_session()
    connection = connect(folder)
    bad = []
    for name in wanted:
        started = time.time()
        try:
            result = QUERIES[name](spark, folder)
            if name in SQL:
                rows, problems = differences(result, connection, SQL[name])
            else:
                rows, problems = len(result.collect()), []
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        kind = "sql" if name in SQL else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {name:34s} {kind:5s} {rows:8d} rows {time.time() - started:7.2f} s", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
        bad += [name] if problems else []
    print(f"{len(wanted) - len(bad)} of {len(wanted)} fine; not: {bad}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
