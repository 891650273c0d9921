"""Registered queries with their DuckDB twins.

Importing the modules below fills ``QUERIES`` and ``ORACLES``.
"""

from importlib import import_module

from .registry import ORACLES, QUERIES

for _name in ("yields", "attempts", "texts", "diagnosis", "parsing", "files", "events", "stream"):
    import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
