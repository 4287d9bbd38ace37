"""Every query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, graphs, predicates, predictions, related, scalars, sets, vectors, wider, windows
from .base import QUERIES, SQL

__all__ = ["aggregates", "graphs", "predicates", "predictions", "related", "scalars", "sets", "vectors", "wider", "windows"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related.join_aliased(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
