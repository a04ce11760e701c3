"""All registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storepulse.plans import queries_facts, queries_identity, queries_reports, queries_streams  # noqa: F401
from storepulse.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["visitors_by_store_and_hour"](spark, sf_dir)
