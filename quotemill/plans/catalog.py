"""All queries of the core, by name, and the SQL that states the same rules for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans import data_quality, line_rules, quotes  # noqa: F401  line_rules registers its queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return quotes.QUERIES | data_quality.QUERIES


def oracle_sql() -> dict[str, str]:
    return quotes.ORACLE | data_quality.ORACLE
