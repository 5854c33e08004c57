"""Compares a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
import re

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def rows_of(table) -> tuple[list[str], list[str]]:
    """Column names, and rows in the order they came."""
    names = sorted(table.column_names)
    return names, list(map(repr, zip(*[table[n].to_pylist() for n in names])))


def ordered(sql: str) -> bool:
    """Whether the whole result has an order, not only a window or a list in it."""
    outside, depth = "", 0
    for c in sql:
        depth += (c == "(") - (c == ")")
        outside += c if not depth else ""
    return re.search(r"\bORDER BY\b", outside) is not None


def same(spark, sf_dir: str, query, sql: str, read=None) -> None:
    """Equal names and rows, in the same order where the SQL has one. ``read`` may convert the query's table first."""
    table = query(spark, sf_dir).toArrow()
    got, want = rows_of(read(table) if read else table), rows_of(connect(sf_dir).sql(sql).to_arrow_table())
    if not ordered(sql):
        got, want = (got[0], sorted(got[1])), (want[0], sorted(want[1]))
    assert got == want
