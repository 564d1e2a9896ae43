"""Compare a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


def rows_of(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def expected(sql: str, folder: str = DATA) -> tuple[list[str], list[str]]:
    found = connection(folder).execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    return columns, sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
