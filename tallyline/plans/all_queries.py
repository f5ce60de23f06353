"""Imports every module that registers queries."""

import importlib

MODULES = ["incident_queries", "interval_queries", "cleaning_queries", "catalog_queries", "source_queries", "report_queries"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
