"""Decimal rounding helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WIDE = "decimal(30,8)"


def half_up(col: Column, digits: int) -> Column:
    """Round a double half-up through a decimal, as ``ROUND(numeric, n)`` does."""
    return F.round(col.try_cast(_WIDE), digits).cast("double")


def half_even(col: Column, digits: int) -> Column:
    """Banker's rounding of a double through a decimal."""
    return F.bround(col.try_cast(_WIDE), digits).cast("double")


def null_if_zero(col: Column) -> Column:
    return F.nullif(col, F.lit(0))


def filled(col: Column) -> Column:
    """The trimmed text, or null when it is blank."""
    return F.nullif(F.trim(col), F.lit(""))
