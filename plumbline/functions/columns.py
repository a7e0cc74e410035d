"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(column: Column) -> Column:
    """NaN becomes NULL, so that a missing number never satisfies a comparison."""
    return F.when(~F.isnan(column), column)


def holds(predicate: Column) -> Column:
    """A predicate over missing values is false."""
    return F.coalesce(predicate, F.lit(False))


def salted_digest(salt: str, *columns: Column) -> Column:
    """Hex digest of the salt and the columns, the same on every engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(salt), *[c.cast("string") for c in columns]))


def uniform_draw(salt: str, *columns: Column) -> Column:
    """Reproducible draw in [0, 1) from the first 32 bits of the salted digest."""
    head = F.substring(salted_digest(salt, *columns), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def display(column: Column, digits: int) -> Column:
    """Round for display, exact ties to even."""
    return F.bround(column, digits)
