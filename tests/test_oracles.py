"""Every query with SQL against DuckDB on the smallest tables, and every other one for its schema."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewire import registry

registry.load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, (list, np.ndarray)):
        return str([plain(v) for v in value])
    if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)):
        return f"{float(value):.5f}".rstrip("0")
    return str(value)


def table(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_as_in_sql(spark, duck, sf, name):
    ours = registry.QUERIES[name](spark, sf).toPandas()
    theirs = duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert table(ours) == table(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert len(registry.QUERIES[name](spark, sf).toPandas().columns) >= 1
