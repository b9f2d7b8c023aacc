import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from sparkgauge.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(data):
    return sorted((tuple(plain(v) for v in r) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = rows(got.select(*columns).collect())
    if name not in queries.SQL:
        assert found
        return
    other = duck.sql(queries.SQL[name])
    assert sorted(other.columns) == columns
    assert found == rows(other.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
