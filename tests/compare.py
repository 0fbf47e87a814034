"""Spark results against SQL on the same tables."""

import os

import duckdb

_CON = {}


def sql_rows(d, text):
    if d not in _CON:
        con = _CON[d] = duckdb.connect()
        for f in os.listdir(d):
            con.sql(f"create view {f.split('.')[0]} as select * from '{d}/{f}'")
    r = _CON[d].sql(text)
    return canon(r.columns, r.fetchall())


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])
