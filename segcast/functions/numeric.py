"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(c: Column | str, nd: int = 0) -> Column:
    """Round the binary double half-to-even at ``nd`` decimals, like Python's ``round``.

    ``bround`` rounds the shortest decimal rendering of the double (so the
    double just above 1.225 becomes 1.22); scaling and ``rint`` rounds the
    value itself (1.23), matching NumPy/Python and DuckDB's ``round_even``.
    -0.0 is normalised to 0.0.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** nd)
    return F.rint(c * scale) / scale + F.lit(0.0)


def at_least(c: Column, low: float) -> Column:
    """``c`` but not under ``low``; null stays null, where ``greatest`` alone would make it ``low``."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
