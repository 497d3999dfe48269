"""Spatial selections and joins over boxes of labelled shapes.

A shapes table has ``shape_id``, flat exact box columns ``l, t, w, h``, ``labels array<string>`` and
``indexed boolean``, within partition keys such as document and page. Joins are equi-joins on the keys
and on square tiles, with the exact predicate on top; a pair is kept in one tile only, that of the
corner of its common part, so nothing needs to be made distinct afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.operators.cluster import connected_components

TILE = 20_000


def with_labels(shapes: DataFrame, *labels: str) -> DataFrame:
    """Indexed shapes that have all the labels."""
    has = F.col("indexed")
    for label in labels:
        has = has & F.array_contains("labels", label)
    return shapes.filter(has)


def index(shapes: DataFrame, ids: Column, on: bool = True) -> DataFrame:
    """Shapes in (or out of) the index, where ``ids`` holds; they exist either way."""
    return shapes.withColumn("indexed", F.when(ids, F.lit(on)).otherwise(F.col("indexed")))


def relabel(shapes: DataFrame, ids: Column, label: str) -> DataFrame:
    return shapes.withColumn("labels", F.when(ids, F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels")))


def search(shapes: DataFrame, query: tuple[int, int, int, int], *labels: str, meets: Callable[[Box, Box], Column] = Box.meets) -> DataFrame:
    """Indexed, fully labelled shapes that meet one constant box; closed unless another predicate is given."""
    return with_labels(shapes, *labels).filter(meets(Box.of(), Box(*(F.lit(v) for v in query))))


def _tiles(df: DataFrame, box: Box, tile: int) -> DataFrame:
    span = lambda low, high: F.sequence(F.floor(low / tile), F.floor(high / tile))
    return df.withColumn("__tx", F.explode(span(box.left, box.right))).withColumn("__ty", F.explode(span(box.top, box.bottom)))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: Callable[[Box, Box], Column] = Box.meets, tile: int = TILE, lp: str = "a", rp: str = "b") -> DataFrame:
    """Pairs of boxes (columns ``{lp}l``.. and ``{rp}l``..) of one key for which ``on`` holds; ``on`` must imply that they meet."""
    a, b = Box.of(lp), Box.of(rp)
    pairs = _tiles(left, a, tile).join(_tiles(right, b, tile), [*keys, "__tx", "__ty"])
    owner = (F.floor(F.greatest(a.left, b.left) / tile) == F.col("__tx")) & (F.floor(F.greatest(a.top, b.top) / tile) == F.col("__ty"))
    return pairs.filter(owner & on(a, b)).drop("__tx", "__ty")


def semi_range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], on: Callable[[Box, Box], Column] = Box.meets, tile: int = TILE, anti: bool = False) -> DataFrame:
    """Rows of ``left`` that some (or, with ``anti``, no) box of ``right`` meets."""
    found = range_join(left.select(*left_id, *[c for c in keys if c not in left_id], "al", "at", "aw", "ah"), right.select(*keys, "bl", "bt", "bw", "bh"), keys, on, tile).select(*left_id).distinct()
    return left.join(found, list(left_id), "left_anti" if anti else "left_semi")


def clusters(members: DataFrame, ties: DataFrame) -> DataFrame:
    """``node`` and representative (the least id) of the clusters that ``ties`` (a, b) make of ``members`` (node)."""
    return connected_components(ties, members)


def cluster_members(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))


def with_attribute(shapes: DataFrame, attribute: DataFrame, name: str) -> DataFrame:
    """Shapes with a typed attribute from a table of its own (``shape_id``, ``name``); null where it isn't set."""
    return shapes.join(attribute.select("shape_id", name), "shape_id", "left")


def to_json(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON text a key: next free id and shapes by id."""
    shape = F.struct("shape_id", "l", "t", "w", "h", "labels", "indexed")
    index_ = F.struct((F.max("shape_id") + 1).alias("nextId"), F.sort_array(F.collect_list(shape)).alias("shapes"))
    return shapes.groupBy(*keys).agg(F.to_json(index_).alias("json"))


def from_json(texts: DataFrame, keys: Sequence[str], column: str = "json") -> DataFrame:
    schema = "nextId bigint, shapes array<struct<shape_id:bigint,l:int,t:int,w:int,h:int,labels:array<string>,indexed:boolean>>"
    return texts.select(*keys, F.inline(F.from_json(column, schema, {"mode": "FAILFAST"})["shapes"]))


def page_slice(page: Box, start: Column | int, size: Column | int, vertical: bool = True) -> Column:
    """A band of a page, clipped to it; null if outside."""
    return page.vertical_slice(start, size) if vertical else page.horizontal_slice(start, size)
