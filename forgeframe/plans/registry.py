"""All registered queries of the site's own operators, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("feed", "listings", "relations", "texts", "changes", "views")


def _all():
    return [importlib.import_module(f"forgeframe.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _all() for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in _all() for k, (_, sql) in m.QUERIES.items() if sql}
