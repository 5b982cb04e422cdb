"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or_zero(x: Column) -> Column:
    """NULL, NaN and both infinities become 0.0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def round_half_even(x: Column, places: int = 4) -> Column:
    """Banker's rounding on doubles (``round`` rounds halves away from zero)."""
    return F.rint(x * 10.0**places) / 10.0**places


def bounded_confidence(score: Column, threshold: Column, scale: Column) -> Column:
    """Sigmoid of the distance from the threshold, mapped to [0, 1).

    ``scale`` is the 95th percentile of the absolute distances of the scope; 0
    counts as 1.
    """
    span = F.when(F.coalesce(scale, F.lit(0.0)) == 0.0, 1.0).otherwise(scale) / 3.0
    return (1.0 / (1.0 + F.exp(-F.abs((score - threshold) / span))) - 0.5) * 2.0


def stddev_or_zero(x: Column) -> Column:
    """Sample standard deviation, 0 with fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))
