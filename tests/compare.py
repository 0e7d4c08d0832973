"""Run a registered query on Spark and its SQL twin on DuckDB and compare the rows.

As a script: ``python tests/compare.py [sf_dir] [key prefix ...]``.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    expected_columns = [d[0] for d in described]
    expected = con.execute(sql).fetchall()
    found: list[str] = []
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} != {sorted(expected_columns)}"]
    theirs = {d[0]: d[1] for d in described}
    for name, kind in df.dtypes:
        if KINDS.get(kind) != theirs[name]:
            found.append(f"type of {name}: {kind} vs {theirs[name]}")
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(expected_columns, expected)
    if len(mine) != len(want):
        found.append(f"{len(mine)} rows, expected {len(want)}")
    if mine != want:
        extra = sorted(set(mine) - set(want))[:2]
        lost = sorted(set(want) - set(mine))[:2]
        found.append(f"values differ; {len(set(mine) - set(want))} rows, e.g. {extra} vs {lost}")
    return found


def main() -> int:
    from faretrace.session import build_session
    from registry import ORACLE, SPARK

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("compare", 8, 8)
    con = connect(sf_dir)
    bad = 0
    for name, fn in SPARK.items():
        if prefixes and not name.startswith(prefixes):
            continue
        begun = time.time()
        try:
            if name in ORACLE:
                problems = differences(fn(spark, sf_dir), con, ORACLE[name])
                note = "ok"
            else:
                rows = fn(spark, sf_dir).collect()
                problems, note = [], f"rows only: {len(rows)} {rows[:2]}"
        except Exception as err:  # report and go on with the next query
            problems = [f"{type(err).__name__}: {str(err)[:600]}"]
        bad += bool(problems)
        print(f"{name:34s} {time.time() - begun:6.2f}s {'; '.join(problems) or note}", flush=True)
    print(f"{bad} with differences")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
