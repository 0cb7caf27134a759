"""Moments as Column expressions over power sums: one aggregation, no second pass.

Every function takes Columns (period returns) and gives an aggregate Column.
Ratios divide through nullif, so an empty or constant series gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0.0))


def m2(x: Column) -> Column:
    return F.avg(x * x) - F.avg(x) * F.avg(x)


def m3(x: Column) -> Column:
    return F.avg(x * x * x) - 3 * F.avg(x) * F.avg(x * x) + 2 * F.pow(F.avg(x), F.lit(3))


def m4(x: Column) -> Column:
    mu = F.avg(x)
    return F.avg(x * x * x * x) - 4 * mu * F.avg(x * x * x) + 6 * mu * mu * F.avg(x * x) - 3 * F.pow(mu, F.lit(4))


def skewness(x: Column, method: str = "population") -> Column:
    g = safe(m3(x), F.pow(m2(x), F.lit(1.5)))
    n = F.count(x)
    return g if method == "population" else g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))


def kurtosis(x: Column, method: str = "population", excess: bool = True) -> Column:
    k = safe(m4(x), F.pow(m2(x), F.lit(2)))
    if method == "sample":
        n = F.count(x)
        g = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * (k - 3) + 6)
        return g if excess else g + 3
    return k - 3 if excess else k


def m11(r: Column, b: Column) -> Column:
    return F.avg(r * b) - F.avg(r) * F.avg(b)


def m12(r: Column, b: Column) -> Column:
    """Coskewness numerator E[(r - Er)(b - Eb)^2]."""
    mr, mb = F.avg(r), F.avg(b)
    return F.avg(r * b * b) - 2 * mb * F.avg(r * b) - mr * F.avg(b * b) + 2 * mr * mb * mb


def m13(r: Column, b: Column) -> Column:
    """Cokurtosis numerator E[(r - Er)(b - Eb)^3]."""
    mr, mb = F.avg(r), F.avg(b)
    return F.avg(r * b * b * b) - 3 * mb * F.avg(r * b * b) + 3 * mb * mb * F.avg(r * b) - mb * mb * mb * mr - mr * m3(b)


def m22(x: Column, y: Column) -> Column:
    """E[(x - Ex)^2 (y - Ey)^2]."""
    a, b = F.avg(x), F.avg(y)
    return F.avg(x * x * y * y) - 2 * b * F.avg(x * x * y) + b * b * F.avg(x * x) - 2 * a * (F.avg(x * y * y) - 2 * b * F.avg(x * y) + b * b * a) + a * a * (F.avg(y * y) - b * b)


def lower_moment(r: Column, target: Column, order: float) -> Column:
    return F.avg(F.pow(F.greatest(target - r, F.lit(0.0)), F.lit(order)))


def upper_moment(r: Column, target: Column, order: float) -> Column:
    return F.avg(F.pow(F.greatest(r - target, F.lit(0.0)), F.lit(order)))
