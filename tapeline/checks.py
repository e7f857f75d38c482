"""Checks: a frame of violations, and raising on the first of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row


class CheckError(ValueError):
    """Input that an operator refuses."""


def require_columns(df: DataFrame, columns, context: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise CheckError(f"{context} lacks columns: {', '.join(missing)}")


def fail_on(violations: DataFrame, say: Callable[[Row], str], *order: str) -> None:
    """Raises with the first violation by `order`; reads one row only."""
    first = (violations.orderBy(*order) if order else violations).limit(1).collect()
    if first:
        raise CheckError(say(first[0]))
