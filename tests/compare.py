"""Run a query in Spark and its oracle in DuckDB and compare the tables."""

from __future__ import annotations

import datetime
import decimal
import math

from docuvet.plans import fixtures


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in fixtures.BASE:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return "DECIMAL " + str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return "COMPLEX " + repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


def compare(spark_df, con, sql):
    """None when equal, else a short description."""
    got_cols, got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first extra {next((r for r in got if r not in want[:50000]), None)}; first missing {next((r for r in want if r not in got[:50000]), None)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(got_cols, a))} != {dict(zip(got_cols, b))}"
    return None
