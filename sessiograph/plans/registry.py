"""A query and its SQL twin, registered under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bindings import Tables, with_sql


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, key: str, needs: str = "", sql: str | None = None):
        """Register a function of ``Tables``; ``needs`` names logical tables its SQL uses."""
        def register(fn: Callable[[Tables], DataFrame]):
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[key] = with_sql(needs, sql) if needs else sql.strip()
            return fn
        return register

    def update(self, other: Registry) -> None:
        for key in other.queries:
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
        self.queries.update(other.queries)
        self.sql.update(other.sql)


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison across engines."""
    if isinstance(c, str):
        return F.round(F.col(c), digits).alias(name or c)
    out = F.round(c, digits)
    return out.alias(name) if name else out
