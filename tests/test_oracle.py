"""Every query equals its SQL counterpart, values, names and types."""

import pytest

import compare
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connection(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns, rows = compare.spark_rows(df)
    duck_columns, duck_rows = compare.duck_rows(duck, ORACLE[name])
    assert columns == duck_columns
    assert rows == duck_rows
    assert not compare.type_differences(df, duck, ORACLE[name])


def test_entry(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert rows and {row.rn for row in rows} <= set(range(1, 11))
