"""All registered queries of the engine and, where SQL can say them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import corpus, evaluation, examples, files, instruction, numbers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (corpus, instruction, evaluation, examples, files, numbers):
    QUERIES |= _module.QUERIES.queries
    ORACLE_SQL |= _module.QUERIES.sql
