"""Compares a query's rows with its SQL in DuckDB."""

import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def text_of(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(text_of(r[i]) for i in order) for r in rows)


def check(frame, sql, connection):
    found = frame.collect()
    wanted = connection.sql(sql)
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert rows_of(frame.columns, found) == rows_of(wanted.columns, wanted.fetchall())
