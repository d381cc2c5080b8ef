"""All queries of the core and their SQL."""

from __future__ import annotations

from tidelog.plans import operators, problems

_MODULES = [problems, operators]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
