"""All queries of the engine by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomry.plans import buildtrees, duplicates, reclaim, space

Query = Callable[[SparkSession, str], DataFrame]
ALL = space.QUERIES | duplicates.QUERIES | buildtrees.QUERIES | reclaim.QUERIES


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
