"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

from estimark.plans import lifecycle, places, raw, rules, sale, scores, tables, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in (scores, places, lifecycle, texts, raw, sale, rules, tables):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
