"""All queries of the library proper, by name."""

from __future__ import annotations

from . import citations, documents, links, market, more, rankings, records, texts, trade

_PLANS = (documents, market, more, records, citations, texts, trade, links, rankings)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
