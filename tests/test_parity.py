"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import pytest
from conftest import TESTDATA
from parity import compare, duck_connection

import __spark_entry__ as contract
from registry.oracles import ORACLES
from registry.spark_queries import QUERIES

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duck_connection(SMALL)
    yield connection
    connection.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) == {"fold_huber", "rank_fit_hinge"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_finite_rows(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows
    for row in rows:
        assert all(v == v and abs(v) != float("inf") for v in row if isinstance(v, float))


def test_entry(spark):
    report = contract.entry(spark)
    levels = [r.level for r in report.collect()]
    assert levels.count("fold") == 20
    assert levels.count("cv") == levels.count("oof") == 1
