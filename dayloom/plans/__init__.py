"""Named queries over the driver tables, each with the SQL that checks it (where SQL can)."""

from __future__ import annotations


def _all() -> dict:
    from dayloom.plans import calendar, content, dashboard, stored

    return {**dashboard.QUERIES, **content.QUERIES, **calendar.QUERIES, **stored.QUERIES}


def queries() -> dict:
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
