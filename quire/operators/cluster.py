"""Clusters: one-dimensional nearest-neighbour bins, sparse histograms, greedy groups and union-find."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import runtime
from quire.functions import fixed

BIN_SCHEMA = "bin int, centroid int, centroid_count bigint, value int, n bigint, size bigint"


def nearest_bins(counts: Sequence[tuple[int, int]], tolerance: float) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Bins of (value, count) pairs: the commonest value (the larger of equals) takes all others nearer than the tolerance, and so on with what is left; the largest bin first."""
    left = sorted(counts, key=lambda c: (-c[1], -c[0]))
    reach, bins = int(tolerance * fixed.SCALE), []
    while left:
        head, rest = left[0], left[1:]
        near = [c for c in rest if abs(c[0] - head[0]) < reach]
        left = [c for c in rest if abs(c[0] - head[0]) >= reach]
        bins.append((head, near))
    return sorted(bins, key=lambda b: -(b[0][1] + sum(n for _, n in b[1])))


def qnn(df: DataFrame, partition: Sequence[str], value: str, tolerance: float = 0.5) -> DataFrame:
    """:func:`nearest_bins` of each partition: a row for each value, with its bin's number, centroid and size.

    Values are counted in the JVM first, so a partition's fold sees only its distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*partition, value).agg(F.count("*").alias("n"))
    kinds = dict(counts.dtypes)
    schema = ", ".join([*(f"`{p}` {kinds[p]}" for p in partition), BIN_SCHEMA])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        keys, rows = [part[p].iloc[0] for p in partition], []
        for i, (head, near) in enumerate(nearest_bins(list(zip(part[value].tolist(), part["n"].tolist(), strict=True)), tolerance)):
            size = head[1] + sum(n for _, n in near)
            rows += [(*keys, i, head[0], head[1], v, n, size) for v, n in [head, *near]]
        return pd.DataFrame(rows, columns=[*partition, "bin", "centroid", "centroid_count", "value", "n", "size"])

    return counts.groupBy(*partition).applyInPandas(fold, schema)


def bin_ranges(bins: DataFrame, partition: Sequence[str]) -> DataFrame:
    """Size, least and largest value of each bin."""
    return bins.groupBy(*partition, "bin", "centroid").agg(F.sum("n").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))


def sparse_histogram(df: DataFrame, partition: Sequence[str], value: str, width: float, to: str = "bucket") -> DataFrame:
    """Counts of ``floor(value / width)``, of the buckets that have any."""
    return df.filter(F.col(value).isNotNull()).groupBy(*partition, F.floor(F.col(value) / F.lit(width)).alias(to)).agg(F.count("*").alias("n"))


def greedy_groups(items: Sequence, related: Callable) -> list[list]:
    """The first item left takes every later one related to it (not to its followers), until none is left."""
    left, out = list(items), []
    while left:
        head, rest = left[0], left[1:]
        out.append([head, *(x for x in rest if related(head, x))])
        left = [x for x in rest if not related(head, x)]
    return out


def cluster_by(df: DataFrame, partition: Sequence[str], order: Sequence[str], related: Callable[[pd.Series, pd.Series], bool], to: str = "grp") -> DataFrame:
    """:func:`greedy_groups` of each partition's rows in order, numbered from 0."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{to}` int"

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order), kind="stable").reset_index(drop=True)
        number = [0] * len(part)
        for k, group in enumerate(greedy_groups(range(len(part)), lambda a, b: related(part.iloc[a], part.iloc[b]))):
            for i in group:
                number[i] = k
        return part.assign(**{to: number})

    return df.groupBy(*partition).applyInPandas(fold, schema)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node`` and the least node of its ``component``; ``edges`` have columns ``a``, ``b``, ``nodes`` a column ``node``.

    Large and small stars take turns until nothing changes, a logarithmic number of rounds; each
    round is written to the shared folder, so the lineage stays short.
    """
    state, e = None, edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = near.select(F.inline(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))).filter("u > m").select("u", F.col("m").alias("v")).distinct()
        e = runtime.written(small, "components")
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if found == state:
            break
        state = found
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return tied
    return nodes.select("node").distinct().join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


class DisjointSets:
    """Union by rank with path halving, for graphs that fit one process; members keep the order in which sets were joined."""

    def __init__(self, items: Iterable[Hashable] = ()):
        self.parent: dict = {}
        self.rank: dict = {}
        self.members: dict = {}
        for x in items:
            self.add(x)

    def add(self, x: Hashable) -> None:
        if x in self.parent:
            raise ValueError(f"{x!r} is there already")
        self.parent[x], self.rank[x], self.members[x] = x, 0, [x]

    def find(self, x: Hashable) -> Hashable:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, *items: Hashable) -> Hashable:
        first = items[0]
        for y in items[1:]:
            a, b = self.find(first), self.find(y)
            if a == b:
                continue
            joined = self.members.pop(a) + self.members.pop(b)
            if self.rank[a] < self.rank[b]:
                a, b = b, a
            self.parent[b] = a
            self.rank[a] += self.rank[a] == self.rank[b]
            self.members[a] = joined
        return self.find(first)

    def of(self, x: Hashable) -> list:
        return self.members[self.find(x)]

    def reorder(self, x: Hashable, key: Callable) -> None:
        self.of(x).sort(key=key)

    def sets(self) -> list[list]:
        return list(self.members.values())
