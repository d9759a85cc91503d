"""Queries that run on the test tables, with the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ("reads", "aggregates", "records", "tables", "streams", "measures", "preparation")


def load():
    """All queries and all SQL texts by name."""
    from tidelog.registered import base

    for module in MODULES:
        importlib.import_module(f"tidelog.registered.{module}")
    return base.QUERIES, base.ORACLES
