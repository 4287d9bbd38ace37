"""Searches: over the rows of one table, over a catalog of tables, and nearest vectors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, ValidationError
from .compile import Compiler, match_score, object_predicate
from .parse import parse

DEFAULT_RESULTS = 15


def bounded(n: int) -> int:
    if not isinstance(n, int) or not 1 <= n <= 50_000:
        raise ValidationError("the number of results lies between 1 and 50000")
    return n


def matching(df: DataFrame, query: Any, presence: str | None = None) -> DataFrame:
    """The rows that a query matches, comparisons with null or missing values being false."""
    return df.where(object_predicate(df, parse(query), presence))


def search_rows(df: DataFrame, query: Any, ident: str, n: int = DEFAULT_RESULTS, presence: str | None = None, rerank: bool = False) -> DataFrame:
    """(id, score): the first n matches by id; reranked, by 1 + a tenth of the conditions met, then id."""
    cond = parse(query)
    score = F.lit(1.0) + (match_score(df, cond, presence) * F.lit(0.1) if rerank else F.lit(0.0))
    out = df.where(object_predicate(df, cond, presence)).select(F.col(ident).alias("id"), score.alias("score"))
    return out.orderBy(F.col("score").desc(), "id").limit(bounded(n))


def search(catalog: Catalog, query: Any, n: int | None = DEFAULT_RESULTS) -> DataFrame:
    """(id): the main table's ids that a query over it and its related tables matches; n=None: all of them."""
    return Compiler(catalog).run(parse(query), None if n is None else bounded(n))
