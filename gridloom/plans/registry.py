"""Where queries are registered, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r(x, n: int = 4):
    return F.round(x, n)
