"""A query's rows against its SQL in DuckDB."""

import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(str(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    out = con.sql(sql)
    names = sorted(out.columns)
    at = [out.columns.index(c) for c in names]
    return names, sorted(tuple(str(r[i]) for i in at) for r in out.fetchall())
