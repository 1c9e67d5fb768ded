"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillframe.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in catalogue.oracle_sql():
        exp = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in exp.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, exp.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.oracle_sql())
