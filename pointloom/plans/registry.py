"""All named queries over the tables of a data folder, with the SQL that they have to match."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("profiles", "ledgers", "packages", "states", "coding", "scenes", "cameras", "jobs", "checks", "stores")


def _load() -> None:
    for name in _MODULES:
        import_module(f"pointloom.plans.{name}")


def queries() -> dict:
    from pointloom.plans.named import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from pointloom.plans.named import ORACLE

    _load()
    return dict(ORACLE)
