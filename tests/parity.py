"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return None if value is None else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=repr)


def compare(df, con, sql: str) -> str | None:
    """NULL when both sides agree, otherwise a short account of the difference."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    expected = _rows(names, relation.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    if len(found) != len(expected):
        return f"rows {len(found)} != {len(expected)}"
    different = [(a, b) for a, b in zip(found, expected, strict=True) if a != b]
    if different:
        return f"{len(different)} of {len(found)} rows differ, e.g. {str(different[0])[:1500]}"
    return None
