"""Registered queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def entries() -> dict[str, tuple[Query, str | None]]:
    from tidepanel.catalog import evaluation, features, fundamentals, portfolio, scans, universe

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (scans, features, universe, fundamentals, portfolio, evaluation):
        found |= module.ENTRIES
    return found
