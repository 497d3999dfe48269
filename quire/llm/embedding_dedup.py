"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits its vectors by their projection on a random direction, near the median, again and
again down to leaves of at most LEAF; a share SPILL of the vectors on either side of a split goes to
both sides, so that near neighbours are seldom parted, and many trees with other directions find what
one parts. All pairs within a leaf are compared by cosine; pairs at or over the threshold are united.

The upper splits of UPPER trees, down to nodes of about NODE_ROWS, are learned a level at a time from a
sample of at most SAMPLE vectors; a node with fewer than LEARN of them isn't split further there. Only the
cuts, two numbers a node, are kept and sent to all tasks, as directions follow from the tree and node
number. Then one pass gives every vector its nodes, and one shuffle brings a node's vectors into one task,
which carries each upper tree on by LOWER trees with splits of their own, exact at the median of the
node's vectors. All vectors are indexed and compared. Equal vectors are compared as one, so no leaf fills
up with copies.

Null, empty and zero vectors, and those with null, NaN or infinite elements, are in no group; vectors
of different lengths are never near. Repeated rows are copies. Splits break ties by row, so leaves
are always small. A null ``vec_id`` takes part and stays null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blobs, column, unblob, written
from quire.llm.components import components

THRESHOLD = 0.95
UPPER, LOWER, LEAF, SPILL, NODE_ROWS = 3, 3, 256, 0.05, 50_000
#: Vectors that the upper splits are learned from, at most, and those that a split needs.
SAMPLE, LEARN = 1 << 22, 64
SEED = 17


def unit_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, length and the normalised vector as bytes of float32, of every row that has a direction."""
    rows = column(rows, key, "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"].cast(pa.list_(pa.float64()))
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = np.asarray(pc.fill_null(pc.list_value_length(v), 0)).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            norm = np.zeros(size.size)
            full = np.flatnonzero(size)
            if full.size:
                norm[full] = np.sqrt(np.add.reduceat(flat * flat, off[:-1][full]))
            good = np.flatnonzero((norm > 0) & np.isfinite(norm))
            cut = np.concatenate([[0], np.cumsum(size[good])])
            at = np.repeat(off[good] - cut[:-1], size[good]) + np.arange(cut[-1])
            unit = (flat[at] / np.repeat(norm[good], size[good])).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch["k"].take(pa.array(good)), pa.array(size[good], pa.int32()), blobs(unit, cut)], ["vec_id", "size", "unit"])

    return rows.select(F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, "vec_id bigint, size int, unit binary")


def _matrix(table) -> np.ndarray:
    flat, off = unblob(table["unit"], np.float32)
    return flat.reshape(len(off) - 1, -1)


def _direction(tree: int, node: int, size: int, seed: int) -> np.ndarray:
    v = np.random.default_rng([seed, tree, node]).standard_normal(size)
    return (v / np.linalg.norm(v)).astype(np.float32)


def leaves(x: np.ndarray, of: np.ndarray, tree: int, node: int, leaf: int, spill: float, seed: int) -> Iterator[np.ndarray]:
    """Rows of the leaves under a node that holds the rows ``of``; a tree of its own number."""
    if of.size <= leaf:
        yield of
        return
    order = of[np.lexsort((of, x[of] @ _direction(tree, node, x.shape[1], seed)))]
    over = int(of.size * spill)
    middle = of.size // 2
    yield from leaves(x, order[: middle + over], tree, 2 * node, leaf, spill, seed)
    yield from leaves(x, order[middle - over :], tree, 2 * node + 1, leaf, spill, seed)


def _ties(x: np.ndarray, parts: Iterator[np.ndarray], threshold: float) -> np.ndarray:
    """For each row the first of its group, by pairs that meet in a part."""
    group = np.arange(len(x))
    for of in parts:
        a, b = np.nonzero(np.triu(x[of] @ x[of].T >= threshold, 1))
        a, b = of[a], of[b]
        while a.size:
            low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
            if (low == high).all():
                break
            np.minimum.at(group, high, low)
            while (group[group] != group).any():
                group = group[group]
    return group


Cuts = dict[tuple[int, int, int], tuple[float, float]]


def nodes(x: np.ndarray, tree: int, cuts: Cuts, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """The lowest nodes of an upper tree that its cuts lead to, with the rows of each."""
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, of = todo.pop()
        cut = cuts.get((x.shape[1], tree, node))
        if cut is None:
            yield node, of
            continue
        p = x[of] @ _direction(tree, node, x.shape[1], seed)
        todo += [(2 * node, of[p <= cut[1]]), (2 * node + 1, of[p >= cut[0]])]


def _by_size(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows that have it, and their vectors as a matrix."""
    size = np.asarray(batch["size"]).astype(np.int64)
    flat, off = unblob(batch["unit"], np.float32)
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        yield int(s), at, flat[off[at][:, None] + np.arange(s)]


def _learned(units: DataFrame, upper: int, spill: float, node_rows: int, sample: int, seed: int) -> Cuts:
    """Cuts of the upper trees, a level at a time, from a bounded sample of all vectors."""
    counts = {r["size"]: r["count"] for r in units.groupBy("size").count().collect()}
    total, largest = sum(counts.values()), max(counts.values(), default=0)
    levels = max(0, math.ceil(math.log(largest / node_rows) / math.log(1 / (0.5 + spill)))) if largest > node_rows else 0
    cuts: Cuts = {}
    if not levels:
        return cuts
    if total > sample:
        units = units.filter(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    few = written(units.select("size", "unit"), "forest-sample")
    for level in range(levels):

        def project(batches: Iterator[pa.RecordBatch], depth: int = level, known: Cuts = dict(cuts)) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for batch in batches:
                for s, _, x in _by_size(batch):
                    for t in range(upper):
                        for node, of in nodes(x, t, known, seed):
                            if node.bit_length() == depth + 1 and of.size:
                                p = x[of] @ _direction(t, node, s, seed)
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(of.size, s), pa.int32()), pa.array(np.full(of.size, t), pa.int32()), pa.array(np.full(of.size, node), pa.int64()), pa.array(p.astype(np.float64))], ["size", "tree", "node", "p"])

        found = few.mapInArrow(project, "size int, tree int, node bigint, p double").groupBy("size", "tree", "node").agg(F.percentile_approx("p", [0.5 - spill, 0.5 + spill], 1000).alias("cut"), F.count("*").alias("n"))
        for r in found.filter(F.col("n") >= LEARN).collect():
            cuts[r["size"], r["tree"], r["node"]] = tuple(r["cut"])
    return cuts


def _placed(units: DataFrame, upper: int, cuts: Cuts, seed: int) -> DataFrame:
    """Every vector with the (tree, node) pairs in whose task it is compared; vectors of one length have their own trees."""
    sent = units.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in _by_size(batch):
                for t in range(upper):
                    for node, of in nodes(x, t, sent.value, seed):
                        part = batch.take(pa.array(at[of]))
                        yield part.append_column("tree", pa.array(np.full(of.size, t), pa.int32())).append_column("node", pa.array(np.full(of.size, node), pa.int64()))

    return units.select("uid", "size", "unit").mapInArrow(run, "uid bigint, size int, unit binary, tree int, node bigint")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, upper: int = UPPER, lower: int = LOWER, leaf: int = LEAF, spill: float = SPILL, node_rows: int = NODE_ROWS, sample: int = SAMPLE, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``group_id`` (the group's smallest ``vec_id``) and ``group_size`` of every row that has a near copy."""
    units = written(unit_vectors(rows, key, vector).withColumns({"uid": F.monotonically_increasing_id(), "k1": F.xxhash64("unit"), "k2": F.xxhash64(F.lit(1), "unit")}), "units")
    alike = units.groupBy("size", "k1", "k2").agg(F.min("uid").alias("first"), F.count("*").alias("n"))
    # only vectors that have equals are told apart from the first of them, so those of no equal aren't moved
    copies = written(units.select("uid", "size", "k1", "k2").join(alike.filter("n > 1"), ["size", "k1", "k2"]).select("uid", "first"), "unit-copies")
    firsts = units.join(copies.filter("uid <> first"), "uid", "left_anti")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid").combine_chunks()
        x, uid = _matrix(table), np.asarray(table["uid"])
        tree, node = table["tree"][0].as_py(), table["node"][0].as_py()
        parts = (part for k in range(lower) for part in leaves(x, np.arange(len(x)), upper + tree * lower + k, node, leaf, spill, seed))
        group = _ties(x, parts, threshold)
        tied = np.flatnonzero(group != np.arange(len(x)))
        return pa.Table.from_arrays([pa.array(uid[tied]), pa.array(uid[group[tied]])], ["a", "b"])

    cuts = _learned(firsts, upper, spill, node_rows, sample, seed)
    pairs = _placed(firsts, upper, cuts, seed).groupBy("size", "tree", "node").applyInArrow(compare, "a bigint, b bigint")
    united = components(written(pairs.unionByName(copies.filter("uid <> first").select(F.col("uid").alias("a"), F.col("first").alias("b"))).distinct(), "forest-pairs"))
    labelled = written(units.select("vec_id", "uid").join(united.withColumnRenamed("node", "uid"), "uid").select("vec_id", F.col("component").alias("grp")), "forest-groups")
    sizes = labelled.groupBy("grp").agg(F.min("vec_id").alias("group_id"), F.count("*").alias("group_size"))
    return labelled.join(sizes, "grp").select("vec_id", "group_id", "group_size")


def jittered(rows: DataFrame) -> DataFrame:
    """Every vector twice, the second time with its elements changed: by up to 1 %, or by up to all of them in every fifth vector."""
    # under another name first: within a lambda, a column of the same select is taken for its new value
    rows = rows.select(F.col("vec_id").alias("old"), F.col("embedding").cast("array<double>").alias("embedding"))
    share = F.when(F.col("old") % 5 == 0, 1.0).otherwise(0.01)
    moved = F.transform("embedding", lambda x, i: x * (1 + share * (((F.col("old") * 31 + (i + 1) * 17) % 11) - 5) / 5.0))
    return rows.select((F.col("old") * 2).alias("vec_id"), "embedding").unionByName(rows.select((F.col("old") * 2 + 1).alias("vec_id"), moved.alias("embedding")))


def _sql(table: str) -> str:
    return f"""
WITH RECURSIVE v AS ({table}),
e AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.embedding, b.embedding) >= {THRESHOLD}),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
c AS (SELECT x AS vec_id, least(min(y), x) AS group_id FROM r GROUP BY x)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM c
"""


SQL = _sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
JITTERED_SQL = _sql("""
  SELECT vec_id * 2 AS vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL
  SELECT vec_id * 2 + 1, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * (1 + (CASE WHEN vec_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END) * (((vec_id * 31 + i * 17) % 11) - 5) / 5.0::DOUBLE)) FROM embeddings""")
