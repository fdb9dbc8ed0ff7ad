"""All queries of the core, by name."""

from __future__ import annotations

from tidebook.plans import market, problems

_MODULES = (market, problems)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
