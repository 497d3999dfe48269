"""Intervals with optional, inclusive or exclusive bounds, as structs; a null bound is infinite."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Interval(NamedTuple):
    start: Column
    end: Column
    start_in: Column
    end_in: Column

    @classmethod
    def field(cls, s: Column) -> Interval:
        return cls(s["start"], s["end"], s["start_in"], s["end_in"])

    @classmethod
    def of(cls, start: Column | None, end: Column | None, start_in: bool = True, end_in: bool = True, kind: str = "int") -> Interval:
        none = F.lit(None).cast(kind)
        return cls(none if start is None else start, none if end is None else end, F.lit(start_in), F.lit(end_in))

    def struct(self) -> Column:
        return F.struct(self.start.alias("start"), self.end.alias("end"), self.start_in.alias("start_in"), self.end_in.alias("end_in"))

    def made(self, whole: bool = False) -> Column:
        """The struct, null if the interval is empty."""
        return F.when(~self.empty(whole), self.struct())

    def empty(self, whole: bool = False) -> Column:
        """Bounds crossed, or equal without both included; of whole numbers also (n, n + 1)."""
        out = (self.start > self.end) | ((self.start == self.end) & ~(self.start_in & self.end_in))
        if whole:
            out = out | ((self.end - self.start == 1) & ~self.start_in & ~self.end_in)
        return F.coalesce(out, F.lit(False))

    def is_point(self) -> Column:
        return F.coalesce((self.start == self.end) & self.start_in & self.end_in, F.lit(False))

    def midpoint(self, whole: bool = False, reach: float = 1000.0) -> Column:
        """Half-way between the bounds (truncated for whole numbers); ``reach`` beyond the one there is; 0 without any."""
        both = self.start.isNotNull() & self.end.isNotNull()
        mid = (self.start + (self.end - self.start) / 2).cast("int" if whole else "double")
        return F.when(both, mid).when(self.start.isNotNull(), self.start + F.lit(reach)).when(self.end.isNotNull(), self.end - F.lit(reach)).otherwise(0)

    def contains(self, p: Column) -> Column:
        low = self.start.isNull() | (p > self.start) | ((p == self.start) & self.start_in)
        high = self.end.isNull() | (p < self.end) | ((p == self.end) & self.end_in)
        return F.coalesce(low, F.lit(True)) & F.coalesce(high, F.lit(True))

    def common(self, other: Interval) -> Interval:
        """Bounds of the intersection, which may be empty."""
        start, end = F.greatest(self.start, other.start), F.least(self.end, other.end)
        at = lambda bound, mine, mine_in, its, its_in: (mine.isNull() | (mine != bound) | mine_in) & (its.isNull() | (its != bound) | its_in)
        return Interval(start, end, F.coalesce(at(start, self.start, self.start_in, other.start, other.start_in), F.lit(False)), F.coalesce(at(end, self.end, self.end_in, other.end, other.end_in), F.lit(False)))

    def intersection(self, other: Interval, whole: bool = False) -> Column:
        return self.common(other).made(whole)

    def intersects(self, other: Interval, whole: bool = False) -> Column:
        return ~self.common(other).empty(whole)

    def same(self, other: Interval) -> Column:
        """Equal bounds; inclusion of an infinite bound doesn't count."""
        return self.start.eqNullSafe(other.start) & self.end.eqNullSafe(other.end) & (self.start.isNull() | (self.start_in == other.start_in)) & (self.end.isNull() | (self.end_in == other.end_in))

    def contains_interval(self, other: Interval) -> Column:
        return ~other.empty() & self.common(other).same(other)

    def left_of(self, other: Interval) -> Column:
        """All of it before all of the other."""
        return F.coalesce((self.end < other.start) | ((self.end == other.start) & ~(self.end_in & other.start_in)), F.lit(False))

    def right_of(self, other: Interval) -> Column:
        return other.left_of(self)

    def left_of_point(self, p: Column) -> Column:
        return F.coalesce((self.end < p) | ((self.end == p) & ~self.end_in), F.lit(False))

    def right_of_point(self, p: Column) -> Column:
        return F.coalesce((self.start > p) | ((self.start == p) & ~self.start_in), F.lit(False))

    def order(self) -> list[Column]:
        """Sort keys: by start, the infinite first and the inclusive before the exclusive, then by end, the infinite last."""
        return [self.start.asc_nulls_first(), (~self.start_in).asc(), self.end.asc_nulls_last(), self.end_in.asc()]


class Span(NamedTuple):
    """Begin and length, half-open."""

    begin: Column
    length: Column

    @property
    def end(self) -> Column:
        return self.begin + self.length

    def struct(self) -> Column:
        return F.struct(self.begin.alias("begin"), self.length.alias("len"))

    def translate(self, by: Column | int) -> Span:
        return Span(self.begin + by, self.length)

    def union(self, other: Span) -> Span:
        begin = F.least(self.begin, other.begin)
        return Span(begin, F.greatest(self.end, other.end) - begin)

    def intersect(self, other: Span) -> Column:
        begin, end = F.greatest(self.begin, other.begin), F.least(self.end, other.end)
        return F.when(begin < end, Span(begin, end - begin).struct())

    def contains(self, i: Column) -> Column:
        return (self.begin <= i) & (self.end > i)

    def contains_span(self, other: Span) -> Column:
        """Begins and ends within; equal ends count."""
        return (self.begin <= other.begin) & (other.end <= self.end)

    def slices(self, n: int) -> Column:
        """n starts from the begin on, equally far apart."""
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: self.begin + (self.length / n).cast("int") * i)
