"""Every query with a SQL twin gives the twin's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from loomwright.plans import catalogue

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(TABLES):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TABLES}/{file}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return f"{float(value):.9g}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, TABLES)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_catalogue_has_no_query_twice():
    packs = [q for pack in catalogue._PACKS for q in pack.QUERIES]
    assert len(packs) == len(set(packs)) == len(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
