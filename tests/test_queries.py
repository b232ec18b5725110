"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(names, found):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = rows(names, (tuple(r) for r in df.select(*names).collect()))
    want = tables.sql(f"SELECT {', '.join(names)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert got == rows(names, want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
