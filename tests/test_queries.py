"""Every registered query against its SQL in DuckDB, and those without SQL for rows."""

from __future__ import annotations

import pytest

import __spark_entry__
from evidra.plans.registry import ORACLES, QUERIES
from oracle import both


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, QUERIES[name], ORACLES[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
