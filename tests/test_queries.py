"""Registered queries beside their SQL, on the smallest tables."""

import os

import pytest
from check_queries import compare, duckdb_with_tables

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return duckdb_with_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, FOLDER, name)
    assert ok, message


def test_entry_has_the_detail_columns(spark):
    assert contract.entry(spark).columns == ["line_id", "original_value", "imputed_value", "error"]


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
