"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "J01_lookup_default"
MODULES: tuple[str, ...] = ("function_queries", "relational_queries", "source_queries", "lexicon_queries")


def queries() -> dict:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"lexloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"lexloom.plans.{name}").SQL
    return found
