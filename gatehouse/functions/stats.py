"""Robust statistics: median, MAD, robust z, and their safe conventions on empty input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes the MAD of a normal sample its standard deviation.
NORMAL = 1.4826


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def median(x: Column) -> Column:
    """The exact median, 0 of nothing."""
    return F.coalesce(F.median(x), F.lit(0.0))


def std(x: Column) -> Column:
    """Sample deviation, 0 of fewer than two."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.coalesce(F.percentile(x, F.lit(min(1.0, max(0.0, q)))), F.lit(0.0))


def robust_z(x: Column, med: Column, mad: Column) -> Column:
    return F.when(mad > 1e-12, (x - med) / (F.lit(NORMAL) * mad)).otherwise(F.lit(0.0))


def ewma(series: Column, alpha: float) -> Column:
    """Exponentially weighted mean of an ordered array, seeded with its first value; 0 if empty."""
    rest = F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0)))
    return F.when(F.size(series) > 0, F.aggregate(rest, F.element_at(series, 1), lambda z, x: F.lit(alpha) * x + F.lit(1 - alpha) * z)).otherwise(F.lit(0.0))


def sha1_short(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, n)
