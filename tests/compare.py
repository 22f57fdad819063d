"""Rows of a query against rows of its SQL in the other engine."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).iterdir()):
        source = p if p.is_file() else f"{p}/*.parquet"
        con.execute(f"create view {p.name.removesuffix('.parquet')} as select * from '{source}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return f"{float(x):.9g}" if x != x.to_integral_value() else str(int(x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return "null" if x is None else str(x)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours = rows_of(df.columns, df.collect())
    if ours == theirs:
        return ""
    a, b = [x for x in ours if x not in set(theirs)][:2], [x for x in theirs if x not in set(ours)][:2]
    return f"{len(ours)} rows against {len(theirs)}; only here {a}, only there {b}"
