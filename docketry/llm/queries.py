"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("suffix", "bpe", "simhash", "langid", "urlfilter", "quality", "tokencount", "topk", "toxicity", "mixing", "fim", "spelling", "packing")


def _modules():
    return [import_module(f"docketry.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
