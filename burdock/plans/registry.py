"""Named queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL that gives the same rows."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import cohort_queries, model_queries, proteome_queries, run_queries, sequence_queries, source_queries, stats_queries  # noqa: F401

    return QUERIES, ORACLES
