"""Comparison of a Spark result with DuckDB's result on the same parquet files."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(_cell(row[i]) for i in places) for row in rows]
    return sorted(names), sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def spark_rows(df: DataFrame):
    return _ordered(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(connection, sql: str):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    return _ordered(names, result.fetchall())


def assert_same(df: DataFrame, connection, sql: str) -> int:
    have_names, have = spark_rows(df)
    want_names, want = duckdb_rows(connection, sql)
    assert have_names == want_names
    assert len(have) == len(want), (len(have), len(want))
    different = [(h, w) for h, w in zip(have, want) if h != w]
    assert not different, different[:3]
    for h, w in zip(have[:50], want[:50]):
        assert [type(v) for v in h] == [type(v) for v in w], (h, w)
    return len(have)
