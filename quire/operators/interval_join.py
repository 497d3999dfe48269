"""Stabbing and overlap joins of intervals by buckets.

Both sides are cut into buckets of equal width and joined on them; the exact predicate is applied on
top, and an overlapping pair is kept in the bucket of the larger start alone. Infinite bounds are
clamped to the other side's range, which one aggregate finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("bigint")


def stab(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Every point with every closed interval that holds it."""
    spread = intervals.filter(F.col(start) <= F.col(end)).withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(end), width))))
    placed = points.withColumn("__b", _bucket(F.col(point), width))
    return spread.join(placed, [*keys, "__b"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("__b")


def stab_counts(intervals: DataFrame, points: DataFrame, start: str, end: str, point: str, width: float, by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """How many points :func:`stab` gives the intervals of each key ``by``, ``n``, and the ``first`` of them. Equal points are counted before they are joined, so the pairs don't grow with both sides."""
    counts = points.groupBy(*keys, point).agg(F.count("*").alias("__c"))
    return stab(intervals.select(*dict.fromkeys([*by, start, end, *keys])), counts, start, end, point, width, keys).groupBy(*by).agg(F.sum("__c").alias("n"), F.min(point).alias("first"))


def overlap(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of closed intervals that have a point in common; null bounds are infinite."""
    (ls, le), (rs, re) = left_bounds, right_bounds
    span = left.agg(F.min(F.coalesce(ls, le)), F.max(F.coalesce(le, ls))).unionAll(right.agg(F.min(F.coalesce(rs, re)), F.max(F.coalesce(re, rs)))).toDF("low", "high").agg(F.min("low"), F.max("high")).first()
    if span[0] is None:
        span = (0, 0)

    def spread(df: DataFrame, s: str, e: str, p: str) -> DataFrame:
        low, high = F.coalesce(F.col(s), F.lit(span[0])), F.coalesce(F.col(e), F.lit(span[1]))
        df = df.withColumn(f"__{p}s", low).withColumn(f"__{p}e", high).filter(f"__{p}s <= __{p}e")
        return df.withColumn("__b", F.explode(F.sequence(_bucket(F.col(f"__{p}s"), width), _bucket(F.col(f"__{p}e"), width))))

    pairs = spread(left, ls, le, "l").join(spread(right, rs, re, "r"), [*keys, "__b"])
    owner = _bucket(F.greatest("__ls", "__rs"), width) == F.col("__b")
    return pairs.filter(owner & (F.col("__ls") <= F.col("__re")) & (F.col("__rs") <= F.col("__le"))).drop("__b", "__ls", "__le", "__rs", "__re")


def distinct_intervals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Set semantics: equal bounds are one interval, whatever their attributes; that of the least attribute row stays."""
    return df.dropDuplicates(list(columns))


def removed(df: DataFrame, gone: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Without the intervals of equal bounds in ``gone``."""
    condition = [df[c].eqNullSafe(gone[c]) for c in columns]
    on = condition[0]
    for c in condition[1:]:
        on = on & c
    return df.join(gone, on, "left_anti")
