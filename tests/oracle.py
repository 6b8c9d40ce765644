"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def expect_same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    want = rows(columns, found.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert len(got) == len(want)
    assert got == want
    return len(got)
