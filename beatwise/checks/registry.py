"""All registered queries, by area."""
from __future__ import annotations

from importlib import import_module

AREAS = ["ingest", "geo", "calendar", "metrics", "neighbours", "zones", "forecast", "partition", "routes",
         "maintenance", "exports"]


def _merged(name: str) -> dict:
    out: dict = {}
    for area in AREAS:
        try:
            module = import_module(f"beatwise.checks.{area}")
        except ModuleNotFoundError as missing:
            if missing.name != f"beatwise.checks.{area}":
                raise
            continue
        for key, value in getattr(module, name).items():
            if key in out:
                raise ValueError(f"{key} is registered twice")
            out[key] = value
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
