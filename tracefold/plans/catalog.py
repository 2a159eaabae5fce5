"""Registry of queries with their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracefold.plans.views import Tables, with_views


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))

    def oracle(self) -> str | None:
        return with_views(self.sql, self.extra) if self.sql else None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None,
          extra: dict[str, str] | None = None) -> Callable:
    """Register a query over the tables of a folder, with its SQL when it has one."""
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = Query(name, build, sql, extra or {})
        return build
    return add


def load() -> dict[str, Query]:
    """All queries; importing the catalogue modules registers them."""
    from tracefold.plans import (check_files, check_graphs, check_intel,  # noqa: F401
                                 check_layout, check_text)
    return QUERIES
