"""Every registered query against its SQL in another engine."""

from __future__ import annotations

import pytest

from sparkwright.plans import registry
from tests.helpers import connect, same

@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, data, con, name):
    df = registry.queries()[name](spark, data)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        same(df, con, sql)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_rules_are_64():
    assert sum(name.startswith("rule_") and name not in ("rule_dismissal_stats", "rule_ineffective_stats") for name in registry.queries()) == 64
