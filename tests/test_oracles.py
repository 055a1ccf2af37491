"""Every query against its SQL, in rows, values and column types."""

import os

import pytest
from compare import duck, duck_bag, schemas, spark_bag

import __spark_entry__ as contract
from dataroute.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def connection():
    with duck(SF_DIR) as opened:
        yield opened


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    df = contract.queries()[name](spark, SF_DIR)
    sql = contract.oracle_sql()[name]
    ours, theirs = schemas(df, connection, sql)
    assert ours == theirs
    expected = duck_bag(connection, sql)
    assert expected, "the SQL side must not be empty"
    actual = spark_bag(df)
    difference = list((actual - expected).items())[:3], list((expected - actual).items())[:3]
    assert actual == expected, difference


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["record"]
    assert df.count() > 0
