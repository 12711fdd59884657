import glob
import os

import duckdb
import pytest

import __spark_entry__
from logloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    out = QUERIES[name](spark, sf_dir)
    cols = sorted(out.columns)
    want = con.execute(ORACLE_SQL[name]).to_arrow_table().to_pylist()
    assert sorted(repr([r[c] for c in cols]) for r in out.collect()) == sorted(repr([r[c] for c in cols]) for r in want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
