"""All named queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testdata import sql
from .model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(body: str | None = None, *ctes: str):
    """Registers a function of a Model as a query, with an oracle: SQL after the named tables."""

    def register(f: Callable[[Model], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if body:
            ORACLES[f.__name__] = sql(body, *ctes) if ctes else body
        return f

    return register


from . import catalog_queries, document_queries, model_queries, recommend_queries, sequence_queries  # noqa: E402, F401
