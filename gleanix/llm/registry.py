"""All queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanix.llm import canonical, encoding, frequency, mixing, near, packing, truncation, weighting

MODULES = [frequency, near, canonical, weighting, encoding, packing, mixing, truncation]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
