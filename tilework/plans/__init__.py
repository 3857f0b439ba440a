"""Queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from tilework.plans import catalogs, models, profiles, scalars
from tilework.plans.models import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

PARTS = (scalars, profiles, models, catalogs)


def queries():
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
