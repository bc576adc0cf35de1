"""Rounding that agrees with exact-binary, half-even rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Round a double the way IEEE-exact formatting does (4.25 -> 4.2, 0.15 -> 0.1).

    ``round`` works on the shortest decimal text of a double and rounds halves
    up, so published scores would differ by a tenth on ties.
    """
    pattern = "0" if digits == 0 else "0." + "0" * digits
    text = F.call_function("format_number", value.cast("double"), F.lit(pattern))
    return text.cast("double") + F.lit(0.0)


def exact_sum(value: Column) -> Column:
    """Order-independent sum of doubles with at most six decimals, up to 1e22 each."""
    return F.sum(value.cast("decimal(28,6)")).cast("double")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ladder(keys: Column, table: dict, default=None) -> Column:
    """A small literal lookup as a ``CASE`` chain."""
    expr = None
    for key, value in table.items():
        cond = keys == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if default is None else expr.otherwise(F.lit(default))
