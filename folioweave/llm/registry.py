"""Queries and SQL of the training-data operators, collected from their modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioweave.llm.oracle import ORACLE  # noqa: F401
from folioweave.llm.queries import QUERIES as _QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(_QUERIES)
