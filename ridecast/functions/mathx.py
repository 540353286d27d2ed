"""Rounding and clipping used on predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c, scale: int = 0) -> Column:
    """Round half to even (2.5 -> 2), as numpy's round does."""
    return F.bround(_col(c), scale)


def floor_rule(c, below: float = 2.0, to: float = 1.0) -> Column:
    """Values under ``below`` become ``to`` (under 2 -> 1, not 2)."""
    x = _col(c)
    return F.when(x < below, F.lit(float(to))).otherwise(x)


def threshold_label(c, under: float = 12.0) -> Column:
    """1 when the value is under the threshold, else 0."""
    return F.when(_col(c) < under, 1).otherwise(0).cast("int")
