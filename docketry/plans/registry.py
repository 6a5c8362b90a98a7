"""All queries of the reporting, billing, document, event and governance modules, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("reporting", "console", "casework", "money", "text", "evidence", "events", "governance", "located", "stored")


def _modules():
    return [import_module(f"docketry.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
