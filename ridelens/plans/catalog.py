"""The full query catalogue: importing this module registers every query."""

from __future__ import annotations

# Each module registers its queries on import.
from ridelens.plans import q_ml, q_ml_exact, q_profile, q_region, q_trip, q_value  # noqa: F401
from ridelens.plans.registry import REGISTRY


def queries():
    return {name: e.build for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.sql for name, e in REGISTRY.items() if e.sql is not None}
