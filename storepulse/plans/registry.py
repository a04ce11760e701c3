"""Queries by name, each with its SQL twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storepulse.plans import probes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Probes object as a query; sql is a SELECT over the probe tables' common table expressions."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(probes.Probes(spark, sf_dir))
        if sql:
            body = sql.strip()
            SQL[f.__name__] = f"WITH RECURSIVE {probes.CTES}" + (f", {body[4:].strip()}" if body[:4].upper() == "WITH" else f" {body}")
        return f

    return register
