"""Where queries are registered, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quorumlake.sources.domain import VIEWS, Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of a Domain under its name; sql may use the views of the domain tables."""

    def add(f: Callable[[Domain], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        ORACLE_SQL[f.__name__] = VIEWS + sql
        return f

    return add
