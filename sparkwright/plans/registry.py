"""All registered queries and their SQL."""

from __future__ import annotations

from types import ModuleType

from sparkwright.plans import assets, crawl, details, findings, log, payloads, probes, projects, rules, serp, streams

MODULES: tuple[ModuleType, ...] = (serp, probes, projects, findings, log, crawl, rules, details, streams, assets, payloads)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in m.ORACLES.items()}
