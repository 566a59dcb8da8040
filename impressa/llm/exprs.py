"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word separators of the contracts.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = "[ \\t-\\r]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.  A plain reference inside a lambda may be
    inlined by the optimizer and then runs once per element."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """The maximal runs of non-separators (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR_RUN), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), chars, "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) - F.length(without(text, chars))).cast("long")
