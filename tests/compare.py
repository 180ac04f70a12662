"""Rows of a Spark result and of a DuckDB query in one comparable form."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows(columns: list[str], values) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def of_spark(df) -> list[tuple]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_duck(con, sql: str) -> list[tuple]:
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return rows(columns, found.fetchall())
