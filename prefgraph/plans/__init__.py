"""Registered queries: operators applied to the given tables, and the SQL that checks them."""

from __future__ import annotations

from prefgraph.plans import attributes, comparisons, effects, inference, models, preferences, scopes, strata, text_heads, tournaments

_ALL = (preferences, comparisons, tournaments, inference, models, effects, text_heads, attributes, scopes, strata)
QUERIES = {name: f for m in _ALL for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _ALL for name, sql in m.ORACLE_SQL.items()}
