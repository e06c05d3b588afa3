"""Collects queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.checks.sqlviews import spark_view, with_clause
from provlake.session import small_methods

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(get, spark) -> DataFrame``; ``get(view)`` returns a view as a DataFrame."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_methods(spark)
            return fn(lambda v: spark_view(spark, sf_dir, v))
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_clause(sql)
        return fn
    return wrap


def joined(c: str | Column, sep: str = "|") -> Column:
    """A list as one text, so both engines compare it by value."""
    return F.concat_ws(sep, c)
