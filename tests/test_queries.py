"""Every registered engine query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from gleaner import registry

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
