"""Every query with a twin gives the twin's rows."""

import os

import duckdb
import pandas as pd
import pytest

from tessera import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    n = type(v).__name__
    return bool(v) if "bool" in n else float(v) if "int" in n or "float" in n else v


def rows(d, cols):
    return sorted((tuple(map(cell, r)) for r in d[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_twin(name, spark, duck):
    d = catalog.QUERIES[name](spark, SF)
    cols = sorted(d.columns)
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    assert rows(d.toPandas(), cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
