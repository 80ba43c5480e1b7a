"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import use_settings
from .bindings import Data, duck_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``f(data) -> DataFrame`` under a name, with the SQL that must give the same rows.

    The SQL may start with its own ``WITH``-style list by the marker ``WITH+``.
    """

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Data(use_settings(spark), folder))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            head = duck_views(*views)
            if text.startswith("WITH+"):
                text = "WITH " + (head + ", " if head else "") + text[5:]
            elif head:
                text = f"WITH {head} {text}"
            ORACLES[name] = text
        return build

    return wrap


def r6(column, name: str):
    return F.round(column, 6).alias(name)
