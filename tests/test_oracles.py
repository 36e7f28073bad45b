"""Every registered query against its SQL, on the smallest folder of tables."""

import os

import oracle
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("RULEMESH_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    names, rows = oracle.spark_rows(contract.queries()[name](spark, FOLDER))
    sql_names, sql_rows = oracle.sql_rows(db, contract.oracle_sql()[name])
    assert names == sql_names
    assert oracle.in_order(rows) == oracle.in_order(sql_rows)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 50
