"""All registered queries and their SQL."""

from __future__ import annotations

from shellgauge.plans import flow_queries, judge_queries, static_queries

MODULES = [static_queries, judge_queries, flow_queries]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in MODULES:
    QUERIES.update(_module.Q)
    ORACLES.update(_module.SQL)
