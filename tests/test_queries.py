"""Every query against its SQL on the smallest tables, as the driver does at a larger size."""

import math
import os

import duckdb
import pytest

from gridmill import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(D):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{D}/{name}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 5)


def compare(df, told):
    names = [c[0] for c in told.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([plain(v) for v in row]) for row in told.fetchall())
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    compare(registry.queries()[name](spark, D), duck.execute(registry.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(registry.SMALL))
def test_small_cases(spark, duck, name):
    run, answer = registry.small_cases()[name]
    assert name not in registry.queries() and name not in registry.oracle_sql()
    compare(run(spark, D), duck.execute(answer))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_beyond_sql_give_rows(spark, name):
    df = registry.queries()[name](spark, D)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)
