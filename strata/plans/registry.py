"""All queries of the library by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan over Tables under its function's name, with its SQL where there is some."""

    def register(plan: Callable[[Tables], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return plan

    return register


from strata.plans import chunking, content, evaluation, governance, retrieval, rules, streams  # noqa: E402,F401
