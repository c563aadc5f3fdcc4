"""Each query against the SQL that must give its rows; the others must run."""

from __future__ import annotations

import os

import pytest
from conftest import SF, plain

from tidewatch.plans.registry import ORACLE_SQL, QUERIES, load

load()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, database):
    got, expected = QUERIES[name](spark, SF).toPandas(), database.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_a_definition_elsewhere(name, spark):
    """Queries without SQL have rows, no number in them is undefined by accident, and another test holds them against their definition."""
    frame = QUERIES[name](spark, SF).toPandas()
    assert len(frame) or name in MAY_BE_EMPTY
    assert not frame.select_dtypes("number").drop(columns=[c for c in frame if c in MAY_BE_NULL], errors="ignore").isna().any().any()
    tests = "".join(open(os.path.join(os.path.dirname(__file__), f)).read() for f in ("test_definitions.py", "test_whole.py", "test_operators.py", "test_functions.py"))
    assert name in tests


#: no candidate on these tables, no hour far enough from both ends
MAY_BE_EMPTY = ("p_two_stage", "l12_random_dates", "p_split_halves")
#: correlations of constant sides, and location errors of nothing found
MAY_BE_NULL = ("r_before", "r_after", "loc_err_median")


def test_entry(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
