"""Forests of parent-child edges: roots, root-to-leaf paths, depth and preorder, by recursive SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are no one's child; edges have columns ``parent`` and ``child``."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def _walk(edges: DataFrame) -> DataFrame:
    # paths have no repeated node, so a walk ends by itself; Spark's own limits (100 levels, a million rows) would end it by an error
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        edges.sparkSession.conf.set(limit, "-1")
    name = f"edges_{uuid.uuid4().hex}"
    edges.select("parent", "child").distinct().createOrReplaceTempView(name)
    roots(edges).createOrReplaceTempView(f"roots_{name}")
    return edges.sparkSession.sql(f"""
        WITH RECURSIVE walk(node, parent, depth, path) AS (
          SELECT node, CAST(NULL AS BIGINT), 0, array(node) FROM (SELECT CAST(node AS BIGINT) AS node FROM roots_{name})
          UNION ALL
          SELECT CAST(e.child AS BIGINT), CAST(e.parent AS BIGINT), w.depth + 1, concat(w.path, array(CAST(e.child AS BIGINT)))
          FROM walk w JOIN {name} e ON e.parent = w.node WHERE NOT array_contains(w.path, CAST(e.child AS BIGINT)))
        SELECT * FROM walk""")


def forest(edges: DataFrame) -> DataFrame:
    """Every node on every way down: ``node, parent, depth, path``; sorting by path gives the preorder, children ascending."""
    return _walk(edges)


def leaf_paths(edges: DataFrame) -> DataFrame:
    """Paths from the roots to the nodes without children."""
    return _walk(edges).join(edges.select(F.col("parent").cast("bigint").alias("node")).distinct(), "node", "left_anti").select("path")


def preorder(edges: DataFrame) -> DataFrame:
    """Nodes with their place in the walk of the whole forest; one sort, as the order is global."""
    from pyspark.sql import Window

    return _walk(edges).withColumn("place", F.row_number().over(Window.orderBy("path"))).select("place", "node", "depth")
