"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import connect, difference
from tidemark.plans import catalog, events, flows, gates, health, ledgers, matches, registry, values, visibility, web  # noqa: F401

DATA = "/root/testdata/sf0.001"
#: Queries that SQL can't express, and the tests that hold them against brute force.
WITHOUT_SQL = {"change_evidence": "tests/test_evidence.py", "near_duplicate_changes": "tests/test_near.py"}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA).toArrow()
    expected = duck.execute(registry.ORACLE_SQL[name]).to_arrow_table()
    assert not difference(found, expected)


def test_all_others_are_tested_elsewhere():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == set(WITHOUT_SQL)


def test_candidates_are_judged_once(spark):
    """The verdict isn't pushed into a filter, which would repeat what it is made of for each row."""
    plan = registry.QUERIES["page_audit_rollup"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter " in line and "regexp_replace" in line]
