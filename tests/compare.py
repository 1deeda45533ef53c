"""Run a registered query beside its SQL counterpart and compare the rows."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in frame_rows), key=repr)


def compare(spark, con, query, sql, folder):
    mine = query(spark, folder)
    got = rows_of([tuple(r) for r in mine.collect()], mine.columns)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(result.fetchall(), columns)
    return sorted(mine.columns) == sorted(columns), got, want
