"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import file_queries, graph_queries, index_queries, resolve_queries, tool_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.impact_of_nation(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**graph_queries.QUERIES, **file_queries.QUERIES, **resolve_queries.QUERIES, **index_queries.QUERIES, **tool_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**graph_queries.ORACLES, **file_queries.ORACLES, **resolve_queries.ORACLES, **index_queries.ORACLES, **tool_queries.ORACLES}
