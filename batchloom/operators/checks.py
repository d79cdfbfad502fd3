"""Checks on schemas, counts and parameters. Each raises on failure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


class CheckFailed(AssertionError):
    """A data check did not hold."""


class SchemaMismatch(CheckFailed):
    """A column is missing or has another type than expected."""


def expect_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Require each named column to have the given type string. Runs no job.

    Further columns are allowed. Returns ``df``.
    """
    actual = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    for name, expected in types.items():
        if actual.get(name) != expected:
            found = actual.get(name, "no such column")
            raise SchemaMismatch(f"column {name}: expected {expected}, found {found}")
    return df


def expect_count(what: str, actual: int, expected: int) -> int:
    """Require an exact count that was already taken."""
    if actual != expected:
        raise CheckFailed(f"{what}: expected {expected}, found {actual}")
    return actual


def expect_rows(df: DataFrame, expected: int, what: str = "rows") -> int:
    """Require an exact row count."""
    return expect_count(what, df.count(), expected)


def expect_positive(**values: int) -> None:
    """Require every parameter to be above zero."""
    for name, value in values.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive, found {value}")
