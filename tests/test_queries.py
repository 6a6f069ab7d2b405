"""Every registered query against its SQL check, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from fleetlens.oracles import ORACLES
from fleetlens.registry import QUERIES
from tools import check_oracles

SF_DIR, LARGER_DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def _connect(folder):
    connection = duckdb.connect()
    for table in check_oracles.TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


@pytest.fixture(scope="module")
def con():
    return _connect(SF_DIR)


@pytest.fixture(scope="module")
def larger():
    return _connect(LARGER_DIR)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, larger, name):
    status, _, _, detail = check_oracles.compare(spark, con, name, SF_DIR)
    if status == "EMPTY":  # too little data to say anything
        status, _, _, detail = check_oracles.compare(spark, larger, name, LARGER_DIR)
    assert status == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0
