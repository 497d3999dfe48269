"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import remove, scratch_path, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    return least.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them; here u > v always."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u > v")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its ``component``, of every node that an edge (``a``, ``b``) ties to another.

    Each round writes its edges, so lineage stays short, and drops those of the round before. Edges
    with a null end and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, path = None, None
    while True:
        last, path = path, scratch_path(spark, "stars")
        e = written(_small(_large(e).distinct()).distinct(), "stars", path)
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if last:
            remove(spark, last)
        if found == state:
            break
        state = found
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
