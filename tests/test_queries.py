"""Every array query gives rows, and those of its SQL twin where it has one."""

import math
from pathlib import Path

import duckdb
import pytest

from cubeloom import catalog, registry  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(same, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(same(r[c]) for c in columns)) for r in df.collect())
    assert rows
    if name in registry.oracle_sql():
        twin = duck.sql(registry.oracle_sql()[name])
        assert sorted(twin.columns) == columns
        at = [twin.columns.index(c) for c in columns]
        assert rows == sorted(repr(tuple(same(r[i]) for i in at)) for r in twin.fetchall())
