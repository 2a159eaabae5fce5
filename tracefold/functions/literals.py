"""Rule tables as literal expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def raw(hex_text: str) -> Column:
    """Binary literal from hex digits."""
    return F.lit(bytearray.fromhex(hex_text))


def lookup(key: Column, table: Mapping) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def first_match(rules: Iterable[tuple[Column, object]],
                default: object = None) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        chain = (chain.when(condition, value) if chain is not None
                 else F.when(condition, value))
    return chain.otherwise(default)


def any_of(conditions: Iterable[Column]) -> Column:
    result = None
    for condition in conditions:
        result = condition if result is None else result | condition
    return result


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(part)) for part in parts)


def contains_any_bytes(content: Column, hex_parts: Iterable[str]) -> Column:
    return any_of(F.contains(content, raw(part)) for part in hex_parts)


def present(entries: Iterable[Column]) -> Column:
    """Array of the non-null entries."""
    return F.array_compact(F.array(*entries))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    An expression used inside a lambda is otherwise evaluated for every element;
    here it is bound to a lambda variable.
    """
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)
