"""Run queries against their SQL: ``python -m checks.compare [folder] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from gleanframe.session import local_session

from . import ORACLES, QUERIES
from .registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cleaned = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
    return sorted(cleaned, key=lambda row: tuple((v is None, str(v)) for v in row))


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def differences(spark, con, name: str, folder: str) -> str | None:
    """None if the Spark rows equal the SQL rows, else what differs."""
    df = QUERIES[name](spark, folder)
    got = df.toPandas()
    if name not in ORACLES:
        return None if len(got) else "no rows"
    relation = con.sql(ORACLES[name])
    want = relation.df()
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    expected = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if kinds != expected:
        return f"schema {sorted(set(kinds.items()) ^ set(expected.items()))}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con, failed = local_session("8"), connect(folder), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            problem = differences(spark, con, name, folder)
        except Exception as error:  # reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        checked = "" if name in ORACLES else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{checked} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
