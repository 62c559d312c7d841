"""Every query with a SQL statement gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from lodestone import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    cols = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in frame.collect()), key=str)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    rows = [dict(zip(names, r)) for r in got.fetchall()]
    assert mine == sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
