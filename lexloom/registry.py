"""All queries of the library by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.operators import applicability, compose, duties, gates, ledgers, retrieval, risk, similarity, versions
from lexloom.plans import segment
from lexloom.sources import documents, readers
from lexloom.streaming import flows

MODULES = (readers, documents, segment, versions, duties, similarity, applicability, compose, risk, retrieval, gates, ledgers, flows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause-level changes between two versions of every source."""
    return queries()["c01_clause_diff"](spark, sf_dir)
