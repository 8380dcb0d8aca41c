"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry
from check_oracles import compare, tables
from oracles import ORACLES
from queries_spark import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


def test_every_query_has_a_twin():
    assert sorted(QUERIES) == sorted(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, sf_dir)
    assert ok, note


def test_entry(spark):
    assert entry(spark).columns[0] == "sim_run_id"
