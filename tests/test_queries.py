"""Every query of the catalogue against its SQL on the smallest tables, where these are there."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cantiga.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(df):
    columns = sorted(df.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return float(v) + 0.0 if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else v

    return sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"q_recover_missing"}))
def test_kernel_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
