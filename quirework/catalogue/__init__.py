"""Registered queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exporting, geometry, imaging, layouts, pixels, progress, quality, running, sourcing

_PARTS = (layouts, geometry, exporting, quality, progress, running, pixels, imaging, sourcing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.SQL.items()}
