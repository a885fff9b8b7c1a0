"""Every registered query with SQL against that SQL, and the rest for rows and a schema."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pytest

from millrace.plans import registry


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, decimal.Decimal, np.integer, np.floating)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:26]
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, oracle, name):
    df = registry.QUERIES[name](spark, sf)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns and isinstance(got, list)
        return
    frame = oracle.execute(registry.ORACLES[name]).df()
    assert sorted(frame.columns) == sorted(df.columns)
    want = [tuple(None if x is None or x is np.nan or str(x) == "NaT" or str(x) == "<NA>" else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in r) for r in frame.itertuples(index=False, name=None)]
    assert rows(df.columns, got) == rows(list(frame.columns), want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
