"""All registered queries with their oracle SQL, by name."""

from __future__ import annotations

from . import analytics, comparisons, documents, facets, intake, reporting, revisions, search, structure

PARTS = (reporting.QUERIES, analytics.QUERIES, documents.QUERIES, facets.QUERIES, comparisons.QUERIES, revisions.QUERIES, intake.QUERIES, structure.QUERIES, search.QUERIES)


def queries() -> dict:
    return {name: f for part in PARTS for name, (f, _) in part.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.items() if sql}
