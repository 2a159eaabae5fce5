"""Registry of rule functions, the extension point for own analyzers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

RULES: dict[str, Callable[..., DataFrame]] = {}


def rule(name: str) -> Callable:
    """Register a DataFrame → DataFrame function under a name."""
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in RULES:
            raise ValueError(f"rule {name} exists")
        RULES[name] = function
        return function
    return add


def run_rule(name: str, *tables: DataFrame, **options) -> DataFrame:
    return RULES[name](*tables, **options)
