"""Core queries by name and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.plans import encode, extracted, files, live, orphans, records, search, tools, wiki

_MODULES = (search, encode, wiki, records, extracted, files, live, orphans, tools)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.oracle_sql().items()}
