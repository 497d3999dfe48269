"""Fixed-point numbers: hundredths in a 32-bit integer column, as all coordinates are kept.

Doubles become exact by truncation towards zero; products and quotients of two exact numbers go
through doubles and are truncated once. Nulls stay null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100


def _col(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def to_exact(x: Column | float) -> Column:
    return (_col(x).cast("double") * SCALE).cast("int")


def as_double(x: Column) -> Column:
    return x / F.lit(100.0)


def as_int(x: Column) -> Column:
    """Whole units, towards zero."""
    return (x / SCALE).cast("int")


def multiply(a: Column, b: Column | float) -> Column:
    """Exact times exact (a column) or times a plain number."""
    other = as_double(b) if isinstance(b, Column) else F.lit(float(b))
    return to_exact(as_double(a) * other)


def divide(a: Column, b: Column | float) -> Column:
    other = as_double(b) if isinstance(b, Column) else F.lit(float(b))
    return to_exact(as_double(a) / other)


def show(x: Column) -> Column:
    """``-0.05``, ``12.30``: sign, whole units and two digits."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(F.abs(x) / SCALE).cast("string"), F.lit("."), F.lpad((F.abs(x) % SCALE).cast("string"), 2, "0"))


def compare_fuzzy(a: Column, b: Column, tolerance: float) -> Column:
    """0 where two exact numbers are nearer than the tolerance, else -1 or 1."""
    x, y = as_double(a), as_double(b)
    return F.when(F.abs(x - y) < tolerance, 0).when(x < y, -1).otherwise(1)


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.least(F.greatest(x, _col(low)), _col(high))


def within(x: Column, low: Column | float, high: Column | float) -> Column:
    return (x >= _col(low)) & (x <= _col(high))


def around(x: Column, percent: float) -> tuple[Column, Column]:
    """Bounds ``percent`` below and above an exact number; the percentage really is one, and the second number is the upper bound."""
    half = multiply(x, percent / 100.0)
    return x - half, x + half
