"""All registered queries of the analytics engine, with their SQL."""

from __future__ import annotations

from siltline.plans import history_queries, log_queries, tree_queries

PLANS = {**history_queries.PLANS, **tree_queries.PLANS, **log_queries.PLANS}
QUERIES = {name: query for name, (query, _) in PLANS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PLANS.items() if sql is not None}
