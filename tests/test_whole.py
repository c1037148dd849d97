"""Queries that once read a part of their rows, against SQL over all of them."""

from __future__ import annotations

import pytest

from sparkwright.plans import registry
from sparkwright.sources.bindings import COMPETITORS, Bound, ctes
from tests.helpers import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_competitor_pool_reads_every_keyword(spark, data, con):
    pool = f"select distinct run_id, domain from (select run_id, unnest({list(COMPETITORS)}) as domain from b_serp union all select run_id, domain from b_serp where item_rank <= 3)"
    same(registry.queries()["competitor_pool"](spark, data), con, ctes("serp") + pool)


_BEST = "select *, row_number() over (partition by run_id order by ms desc, title) as place from (select run_id, title, max(savings_ms) as ms from a group by all)"
_AUDITS = "with a as (select l_suppkey % 5 as run_id, 'audit' || (l_partkey % 23) as title, l_quantity * 100 as savings_ms from lineitem) "


def test_psi_clues_reads_every_line(spark, data, con):
    same(registry.queries()["psi_clues"](spark, data), con, _AUDITS + f"select * from ({_BEST}) where place <= 5")


def test_rule_t09b_reads_every_line(spark, data, con):
    got = registry.queries()["rule_t09b"](spark, data).select("run_id", "measure")
    same(got, con, _AUDITS + f"select run_id, max(ms) as measure from ({_BEST}) where place <= 8 group by run_id")


def test_every_line_is_an_audit(spark, data):
    assert Bound(spark, data).lab_audits.count() == spark.read.parquet(f"{data}/lineitem.parquet").count()
