"""Comparing a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pyarrow as pa

DIR = os.environ.get("LECTERN_TEST_DIR", "/root/testdata/sf0.001")


def kind(t):
    """What a column holds; whole numbers of any width are one kind, and so are other numbers."""
    if pa.types.is_integer(t) or pa.types.is_decimal(t) and t.scale == 0:
        return "whole"
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return "number"
    return "text" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def shown(x):
    if isinstance(x, float):
        return "null" if x != x else f"{x:.6f}"
    return "null" if x is None else str(x)


def values(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(shown, row)) for row in zip(*(table.column(n).to_pylist() for n in names), strict=True))


def compare(spark, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = query(spark, DIR).toArrow(), con.sql(sql).fetch_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert {n: kind(got.schema.field(n).type) for n in got.column_names} == {n: kind(want.schema.field(n).type) for n in want.column_names}
    assert values(got) == values(want)
