"""All registered queries; importing a plan module registers its queries."""

from __future__ import annotations

from tidemark.plans import branches, features, forecasts, ingest, models, moves, products, response  # noqa: F401
from tidemark.plans.registry import QUERIES


def builders():
    return {name: q.build for name, q in QUERIES.items()}


def twins():
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
