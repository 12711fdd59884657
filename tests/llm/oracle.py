"""Spark rows against DuckDB rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def sql_rows(con, sql, columns):
    got = con.execute(sql).to_arrow_table().to_pylist()
    return sorted(repr([r[c] for c in columns]) for r in got)


def spark_rows(df, columns):
    return sorted(repr([r[c] for c in columns]) for r in df.select(*columns).collect())


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == sql_rows(con, sql, columns)
