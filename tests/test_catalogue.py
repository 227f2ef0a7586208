"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__ as driver
from sortilex.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert names == sorted(found.columns)
    assert plain(df.select(*names).collect()) == plain(found.select(*names).fetchall())


def test_driver(spark):
    assert driver.entry(spark).count() == 700
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
