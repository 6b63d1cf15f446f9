"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

from quillon import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def compare(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    cursor = duck.execute(sql)
    at = [x[0] for x in cursor.description]
    assert sorted(at) == names
    want = sorted(str([plain(r[at.index(n)]) for n in names]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
