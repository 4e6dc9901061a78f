"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations


def _registered():
    from quire.plans import geometry, intake, records, regions, spans, trees  # noqa: F401  (importing them registers their queries)

    return intake


def all_queries() -> dict:
    return dict(_registered().Q)


def all_sql() -> dict[str, str]:
    return dict(_registered().S)
