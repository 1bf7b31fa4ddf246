"""Named queries over the fixture tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from tracegrid.plans import blocks, features, models, planes, rows, scenes, sessions, statistics, sweeps, terrain  # noqa: F401  they register their queries
from tracegrid.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
