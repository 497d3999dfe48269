"""Grouping of ordered rows: runs, splits, neighbours and differences.

All but :func:`group_by_window` are one window over (partition, order): one shuffle on the partition
keys, shared by every operator that uses the same keys. ``order`` must be total within a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Pick = Callable[[str], Column]


def over(partition: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def _running(df: DataFrame, w: WindowSpec, breaks: Column, to: str) -> DataFrame:
    """Number of breaks so far; the first row's is none."""
    flag = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks, F.lit(True)).cast("int"))
    return df.withColumn("__flag", flag).withColumn(to, F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__flag")


def group_by_pairs(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], same: Callable[[Pick, Pick], Column], to: str = "grp") -> DataFrame:
    """Numbers groups from 0; a row opens a new one where ``same(previous, current)`` isn't true."""
    w = over(partition, order)
    return _running(df, w, ~F.coalesce(same(lambda c: F.lag(c).over(w), F.col), F.lit(False)), to)


def split_on_pairs(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], cut: Callable[[Pick, Pick], Column], to: str = "grp") -> DataFrame:
    """Numbers groups from 0; a row opens a new one where ``cut(previous, current)`` is true."""
    w = over(partition, order)
    return _running(df, w, F.coalesce(cut(lambda c: F.lag(c).over(w), F.col), F.lit(False)), to)


def spans(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], predicate: Column, to: str = "grp", flag: str = "holds") -> DataFrame:
    """Maximal runs in which a predicate holds or doesn't, and whether it does; null counts as not."""
    df = df.withColumn(flag, F.coalesce(predicate, F.lit(False)))
    return group_by_pairs(df, partition, order, lambda p, c: p(flag) == c(flag), to)


def group_by_window(df: DataFrame, partition: Sequence[str], order: Sequence[str], fits: Callable[[pd.DataFrame, pd.Series], bool], to: str = "grp") -> DataFrame:
    """Greedy groups: a row joins the group before it if ``fits(rows of the group so far, row)``.

    Depends on the group so far, so each partition is folded in order by one Python call.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{to}` int"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable").reset_index(drop=True)
        start, number, numbers = 0, 0, []
        for i in range(len(part)):
            if i and not fits(part.iloc[start:i], part.iloc[i]):
                start, number = i, number + 1
            numbers.append(number)
        return part.assign(**{to: numbers})

    return df.groupBy(*partition).applyInPandas(fold, schema)


def unique_count_by(df: DataFrame, partition: Sequence[str], key: str, order: str, value: str) -> DataFrame:
    """Per key, how many rows, and the value of the first in order."""
    return df.groupBy(*partition, key).agg(F.count("*").alias("n"), F.min_by(value, order).alias("first_value"))


def unique_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = over(keys, order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def trim(df: DataFrame, partition: Sequence[str], order: str, predicate: Column) -> DataFrame:
    """Without the leading and trailing rows that satisfy a predicate."""
    w = Window.partitionBy(*partition)
    kept = F.when(~F.coalesce(predicate, F.lit(False)), F.col(order))
    return df.withColumn("__a", F.min(kept).over(w)).withColumn("__b", F.max(kept).over(w)).filter(F.col(order).between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def sliding(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], column: str, n: int) -> DataFrame:
    """Every n following values as an array; a shorter partition gives one array of all it has."""
    w = over(partition, order)
    size = F.count("*").over(Window.partitionBy(*partition))
    array = F.collect_list(column).over(w.rowsBetween(0, n - 1))
    return df.withColumn("window", array).withColumn("__size", size).withColumn("__i", F.row_number().over(w)).filter((F.size("window") == n) | ((F.col("__i") == 1) & (F.col("__size") < n))).drop("__size", "__i")


def deltas(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], column: str, to: str = "delta") -> DataFrame:
    """Difference from the row before; the first row has none and is dropped."""
    w = over(partition, order)
    return df.withColumn(to, F.col(column) - F.lag(column).over(w)).filter(F.col(to).isNotNull())


def vertical_jumps(df: DataFrame, partition: Sequence[str], y: str, tie: Sequence[str]) -> DataFrame:
    """Each row's y and the distance to the next one down."""
    w = over(partition, [y, *tie])
    return df.withColumn("jump", F.lead(y).over(w) - F.col(y)).filter(F.col("jump").isNotNull())


def item_gaps(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], left: str, right: Column, to: str = "gap") -> DataFrame:
    """Distance from each item's right edge to the next one's left; 0 for the last."""
    w = over(partition, order)
    return df.withColumn(to, F.coalesce(F.lead(left).over(w) - right, F.lit(0)))


def consecutive(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], key: str, to: str = "follows") -> DataFrame:
    """Whether a row's id is the one before's plus 1; null for the first."""
    w = over(partition, order)
    return df.withColumn(to, F.lag(key).over(w) == F.col(key) - 1)


def neighbours(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column], columns: Sequence[str], before: int = 1, after: int = 1) -> DataFrame:
    """A cursor's view of every row: the columns of the rows ``before`` and ``after`` it as structs, null beyond the ends."""
    w = over(partition, order)
    row = F.struct(*columns)
    for i in range(1, before + 1):
        df = df.withColumn(f"prev{i}", F.lag(row, i).over(w))
    for i in range(1, after + 1):
        df = df.withColumn(f"next{i}", F.lead(row, i).over(w))
    return df


class Cursor:
    """A place in a sequence with what is before and after it; every move gives a new cursor or None."""

    def __init__(self, items: Sequence, at: int = 0, width: int = 1):
        self.items, self.at, self.width = tuple(items), at, width

    @property
    def window(self) -> tuple:
        return self.items[self.at : self.at + self.width]

    def next(self) -> Cursor | None:
        return Cursor(self.items, self.at + self.width) if self.at + self.width < len(self.items) else None

    def prev(self) -> Cursor | None:
        return Cursor(self.items, self.at - 1) if self.at > 0 else None

    def move(self, n: int) -> Cursor | None:
        return Cursor(self.items, self.at + n) if 0 <= self.at + n < len(self.items) else None

    def insert(self, *items) -> Cursor:
        return Cursor((*self.items[: self.at], *items, *self.items[self.at :]), self.at)

    def widen(self, n: int = 1) -> Cursor | None:
        """Takes in n more items on the right if there are as many."""
        return Cursor(self.items, self.at, self.width + n) if self.at + self.width + n <= len(self.items) else None

    def slurp_right(self, fits: Callable) -> Cursor:
        cursor = self
        while (wider := cursor.widen()) is not None and fits(cursor.window, wider.window[-1]):
            cursor = wider
        return cursor

    def find_next(self, test: Callable) -> Cursor | None:
        return next((Cursor(self.items, i) for i in range(self.at, len(self.items)) if test(self.items[i])), None)

    def find_prev(self, test: Callable) -> Cursor | None:
        return next((Cursor(self.items, i) for i in range(self.at, -1, -1) if test(self.items[i])), None)

    def close(self) -> tuple:
        return self.items

    def unfold(self, fits: Callable) -> list[tuple]:
        """The items from here on, cut into greedy windows."""
        out, cursor = [], self
        while cursor is not None:
            cursor = cursor.slurp_right(fits)
            out.append(cursor.window)
            cursor = cursor.next()
        return out
