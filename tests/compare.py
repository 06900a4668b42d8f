"""Compare a query's rows with its SQL's, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float, decimal.Decimal)):
        return (2, f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return (3, x.replace(tzinfo=None).isoformat())
    return (4, str(x))


def rows_of(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in rows])


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both give the same rows."""
    own, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs, wanted = rows_of([d[0] for d in got.description], got.fetchall())
    if own != theirs:
        return f"columns {own} and {theirs}"
    if mine != wanted:
        a, b = [x for x in mine if x not in set(wanted)][:2], [x for x in wanted if x not in set(mine)][:2]
        return f"{len(mine)} and {len(wanted)} rows; only here: {a}; only there: {b}"
    return ""
