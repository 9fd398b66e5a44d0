"""All registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ["relational", "temporal", "retrieval", "store_log", "analysis", "search", "directions", "objects"]


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"stratalake.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"stratalake.plans.{name}").ORACLES
    return found
